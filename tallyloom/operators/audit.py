"""Data-quality audits: which simple predicates give a class away, what can be derived from what."""

from __future__ import annotations

import heapq
import math
from itertools import combinations, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, text
from . import windows

#: Levels of a column that are tried, and what a predicate must reach to count.
LEVELS, MIN_PRECISION, MIN_RECALL, MIN_LIFT = 40, 0.90, 0.50, 2.0


def levels(df: DataFrame, columns: list[str], most: int = LEVELS) -> DataFrame:
    """column, level, n: the most frequent values of each column, from one pass over all of them."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))))
    n = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "level"))
    return n.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def predicate_scores(df: DataFrame, member: str, columns: list[str], most: int = LEVELS) -> DataFrame:
    """Precision, recall (basis points) and counts of each equality or null predicate against a class."""
    long = df.select(F.expr(member).alias("m"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))))
    n = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("support"), F.count_if("m").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("support"), "level"))
    total = F.broadcast(df.agg(F.count_if(F.expr(member)).alias("size"), F.count(F.lit(1)).alias("all")))
    t = n.withColumn("r", rank).where(F.col("r") <= most).drop("r").crossJoin(total)  # one row
    bp = lambda a, b: F.call_function("div", a * 10_000, F.greatest(b, F.lit(1)))
    t = t.withColumns({"precision_bp": bp(F.col("hits"), F.col("support")), "recall_bp": bp(F.col("hits"), F.col("size"))})
    leak = (F.col("precision_bp") >= int(MIN_PRECISION * 10_000)) & (F.col("recall_bp") >= int(MIN_RECALL * 10_000)) & (F.col("hits") * F.col("all") >= MIN_LIFT * F.col("support") * F.col("size"))
    return t.select("column", "level", "support", "hits", "precision_bp", "recall_bp", leak.alias("leaks"))


def pair_scores(df: DataFrame, member: str, columns: list[str], most: int = 6) -> DataFrame:
    """Conjunctions of the most frequent levels of two columns, by support and hits."""
    frequent = levels(df, columns, most)
    pairs = F.array(*(F.struct(F.lit(a).alias("c1"), F.col(a).cast("string").alias("l1"), F.lit(b).alias("c2"), F.col(b).cast("string").alias("l2")) for a, b in combinations(columns, 2)))
    n = df.select(F.expr(member).alias("m"), F.inline(pairs)).groupBy("c1", "l1", "c2", "l2").agg(F.count(F.lit(1)).alias("support"), F.count_if("m").alias("hits"))
    known = lambda c, lv: F.broadcast(frequent.select(F.col("column").alias(c), F.col("level").alias(lv)))  # noqa: E731  at most ``most`` levels a column
    return n.join(known("c1", "l1"), ["c1", "l1"]).join(known("c2", "l2"), ["c2", "l2"]).select("c1", "l1", "c2", "l2", "support", "hits")


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """determinant, dependent, holds: whether each value of one column has one value of the other; near-unique columns determine nothing of interest."""
    others = lambda a: [b for b in columns if b != a]
    out = None
    for a in columns:  # one grouping for each determinant, whatever it may determine
        per = df.where(F.col(a).isNotNull()).groupBy(a).agg(F.count(F.lit(1)).alias("__n"), *(F.min(b).eqNullSafe(F.max(b)).alias(f"__{b}") for b in others(a)))
        row = per.agg(F.count(F.lit(1)).alias("keys"), F.sum("__n").alias("n"), *(F.every(f"__{b}").alias(f"__{b}") for b in others(a)))
        each = F.array(*(F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), (F.col(f"__{b}") & (F.col("keys") * 2 < F.col("n"))).alias("holds")) for b in others(a)))
        row = row.select(F.inline(each))
        out = row if out is None else out.unionByName(row)
    return out


def derivable_sums(df: DataFrame, target: str, parts: list[str]) -> DataFrame:
    """How many rows have ``target`` as the sum or difference of two other columns, for each pair."""
    kinds = [(a, b, sign) for a, b in combinations(parts, 2) for sign in ("+", "-")]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(target) == (F.col(a) + F.col(b) if s == "+" else F.col(a) - F.col(b))).alias(f"h{k}") for k, (a, b, s) in enumerate(kinds)))
    return counts.select("n", F.inline(F.array(*(F.struct(F.lit(f"{a} {s} {b}").alias("expression"), F.col(f"h{k}").alias("hits")) for k, (a, b, s) in enumerate(kinds)))))


def value_collisions(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values that several rows of a key share."""
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def predicates(df: DataFrame, member: str, columns: list[str], notes: str | None = None, most: int = LEVELS) -> DataFrame:
    """column, predicate, support, hits of every simple predicate that the columns admit, against a class.

    Null and not null; the levels of a column that has ``most`` at most; every value of a number as a lower and
    as an upper bound; its ``most`` commonest words; and for ``notes``, a JSON object, whether a key is
    absent, its keys, and its pairs. Bounds come from running sums over the counts by value.
    """
    return _predicates(df, member, columns, notes, most).drop("kind")


def _predicates(df: DataFrame, member: str, columns: list[str], notes: str | None, most: int) -> DataFrame:
    m = F.expr(member)
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(df.schema[c].dataType.typeName() == "string").alias("text"))
    long = df.select(m.alias("m"), F.inline(F.array(*map(one, columns))))
    counted = [F.count(F.lit(1)).alias("support"), F.count_if("m").alias("hits")]
    levels_ = long.groupBy("column", "value").agg(*counted)
    shown = lambda x, text, kind: x.select("column", text.alias("predicate"), "support", "hits", F.lit(kind).alias("kind"))
    nulls = levels_.groupBy("column", F.col("value").isNull().alias("null")).agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"))
    some = nulls.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where("k = 2")  # null for some rows only
    out = shown(nulls.join(some, "column"), F.when(F.col("null"), "is null").otherwise("is not null"), "null")
    few = levels_.where("value IS NOT NULL").groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    out = out.unionByName(shown(levels_.where("value IS NOT NULL").join(few, "column"), F.concat(F.lit("= "), "value"), "level"))
    for name in [c for c in columns if df.schema[c].dataType.typeName() in ("long", "integer", "short")]:
        by_value = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(m).alias("h"))
        total = F.broadcast(by_value.agg(F.sum("n").alias("all_n"), F.sum("h").alias("all_h"), F.count(F.lit(1)).alias("k")))
        up = windows._running(by_value.select("v", "n"), "v").select("v", F.col("upto").alias("n_up"))
        hits = windows._running(by_value.select("v", F.col("h").alias("n")), "v").select("v", F.col("upto").alias("h_up"))
        both = by_value.join(up, "v").join(hits, "v").crossJoin(total).where("k >= 4")
        bound = lambda sign, n, h: F.struct(F.lit(name).alias("column"), F.concat(F.lit(f"{sign} "), F.col("v").cast("string")).alias("predicate"), n.alias("support"), h.alias("hits"), F.lit("bound").alias("kind"))  # noqa: B023, E731
        out = out.unionByName(both.select(F.inline(F.array(
            bound("<=", F.col("n_up"), F.col("h_up")), bound(">=", F.col("all_n") - F.col("n_up") + F.col("n"), F.col("all_h") - F.col("h_up") + F.col("h"))))))
    words = long.where("text AND value IS NOT NULL").select("m", "column", F.explode(text.tokens(F.col("value"))).alias("word")).groupBy("column", "word").agg(*counted)
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("support"), "word"))
    out = out.unionByName(shown(words.withColumn("r", place).where(F.col("r") <= most), F.concat(F.lit("contains "), "word"), "word"))
    if notes:
        pairs = df.select(m.alias("m"), F.explode(F.from_json(notes, "map<string,string>")).alias("key", "value"))
        keys = pairs.groupBy(F.lit(notes).alias("column"), "key").agg(*counted)
        whole = F.broadcast(df.agg(F.count(F.lit(1)).alias("all_n"), F.count_if(m).alias("all_h")))
        absent = keys.crossJoin(whole).select("column", F.concat(F.lit("without "), "key").alias("predicate"), (F.col("all_n") - F.col("support")).alias("support"), (F.col("all_h") - F.col("hits")).alias("hits"), F.lit("without").alias("kind")).where("support > 0")
        pair = pairs.groupBy(F.lit(notes).alias("column"), "key", "value").agg(*counted)
        commonest = pair.orderBy(F.desc("support"), "key", "value").limit(2 * most)
        out = out.unionByName(shown(keys, F.concat(F.lit("with "), "key"), "with")).unionByName(absent)
        out = out.unionByName(shown(commonest, F.concat("key", F.lit(" = "), "value"), "pair"))
    return out


#: Predicates of a column that conjunctions are made of, and the share of false alarms that a family of tests may have.
PAIR_TOP, ALPHA = 6, 0.01


def best_predicates(found: DataFrame, total: int, best: int = PAIR_TOP) -> list:
    """The ``best`` predicates of each column by precision, then hits, then text; those of all rows or none say nothing."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc(F.col("hits") / F.col("support")), F.desc("hits"), "predicate", "kind"))
    some = found.where(F.col("support").between(1, total - 1)).withColumn("r", place).where(F.col("r") <= best)
    return sorted(some.select("column", "predicate", "kind").collect())  # ``best`` a column


def fulfils(column: str, predicate: str, kind: str) -> Column:
    """Whether a row fulfils a predicate of ``predicates``; never null."""
    value = F.col(column)
    pairs = F.from_json(value, "map<string,string>") if kind in ("with", "without", "pair") else None
    after = lambda head: F.lit(predicate[len(head):])
    if kind == "null":
        return value.isNull() if predicate == "is null" else value.isNotNull()
    if kind == "level":
        holds = value.cast("string") == after("= ")
    elif kind == "bound":
        bound = F.lit(int(predicate[3:]))
        holds = value <= bound if predicate.startswith("<=") else value >= bound
    elif kind == "word":
        holds = F.array_contains(text.tokens(value), after("contains "))
    elif kind == "pair":
        holds = F.exists(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]) == predicate)
    else:
        holds = F.map_contains_key(pairs, after(f"{kind} "))
    holds = F.coalesce(holds, F.lit(False))
    return ~holds if kind == "without" else holds


def conjunctions(df: DataFrame, member: str, chosen: list) -> DataFrame:
    """c1, p1, c2, p2, support, hits: how many rows, and of the class, fulfil two predicates of different columns at once.

    Each block of rows is a bitmap for every predicate; a conjunction is their bits in common. A task adds its blocks up and
    returns one count for each pair, so what is shuffled depends on the number of predicates alone. Pairs without a hit are left out.
    """
    import pyarrow as pa

    pairs = [(i, j) for i, j in combinations(range(len(chosen)), 2) if chosen[i]["column"] != chosen[j]["column"]]
    names = "c1 string, p1 string, c2 string, p2 string"
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], f"{names}, support long, hits long")

    def count(batches):
        support, hits = np.zeros((2, len(chosen), len(chosen)), np.int64)
        for batch in batches:
            bits = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            packed = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)
            of_class, maps = packed[0], packed[1:]
            for i in range(len(maps) - 1):
                both = maps[i] & maps[i + 1:]
                support[i, i + 1:] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                hits[i, i + 1:] += np.bitwise_count(both & of_class).sum(axis=1, dtype=np.int64)
        at = tuple(np.array(pairs).T)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(support[at]), pa.array(hits[at])], names=["pair", "support", "hits"])

    tests = df.select(F.coalesce(F.expr(member), F.lit(False)).alias("m"), *(fulfils(*x).alias(f"t{k}") for k, x in enumerate(chosen)))
    n = tests.mapInArrow(count, "pair long, support long, hits long").groupBy("pair").agg(F.sum("support").alias("support"), F.sum("hits").alias("hits")).where("hits > 0")
    known = spark.createDataFrame([(k, *chosen[i][:2], *chosen[j][:2]) for k, (i, j) in enumerate(pairs)], f"pair long, {names}")
    return n.join(F.broadcast(known), "pair").select("c1", "p1", "c2", "p2", "support", "hits")


def best_pairs(df: DataFrame, member: str, columns: list[str], notes: str | None = None, best: int = PAIR_TOP) -> DataFrame:
    """Conjunctions of the best predicates of every two columns, scored."""
    n = df.agg(F.count_if(F.expr(member)).alias("size"), F.count(F.lit(1)).alias("total")).first()
    chosen = best_predicates(_predicates(df, member, columns, notes, LEVELS), n["total"], best)
    return scored(conjunctions(df, member, chosen).where(F.col("support") < n["total"]), n["size"], n["total"])


def scored(found: DataFrame, size: int, total: int) -> DataFrame:
    """Predicates with precision, recall and lift in basis points, the chance of as many hits, and whether they leak.

    A predicate of more than half of all rows is too wide to say anything.
    """
    bp = lambda a, b: F.call_function("div", a * 10_000, F.greatest(b, F.lit(1)))
    t = found.withColumns({"precision_bp": bp(F.col("hits"), F.col("support")), "recall_bp": bp(F.col("hits"), F.lit(size))})
    t = t.withColumn("lift_bp", F.call_function("div", F.col("precision_bp") * F.lit(total), F.greatest(F.lit(size), F.lit(1))).cast("long"))

    @F.pandas_udf("double")
    def chance(hits: pd.Series, support: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_tails(hits.to_numpy(), support.to_numpy(), size, total))

    wide = F.col("support") * 2 > total
    leak = (F.col("precision_bp") >= int(MIN_PRECISION * 10_000)) & (F.col("recall_bp") >= int(MIN_RECALL * 10_000)) & (F.col("lift_bp") >= int(MIN_LIFT * 10_000)) & ~wide
    return t.withColumn("p_value", chance("hits", "support")).withColumns({"leaks": leak})


#: Members below which a class can't be tested, the share above which it is no class, and hits that a test needs.
LEAST_MEMBERS, MOST_SHARE = 3, 0.5


def class_audits(df: DataFrame, classes: dict[str, str], columns: list[str], notes: str | None = None) -> DataFrame:
    """One row for each class: its size, whether it can be tested, how many predicates and conjunctions leak it and the best predicate, by precision times recall.

    A class is ``underpowered`` if not even a predicate that holds for just its rows could be told from chance, with
    ``ALPHA`` shared among the predicates (the conjunctions) that are tried: its leaks are shown and count for nothing.
    ``n_certified`` are predicates and conjunctions beyond chance.
    """
    from .storage import kept  # not in the module: tasks get its functions by value, and tables are the driver's

    sizes = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.expr(c)).alias(f"c{k}") for k, c in enumerate(classes.values()))).first()
    out = None
    for k, (name, member) in enumerate(classes.items()):
        size, total = sizes[f"c{k}"], sizes["total"]
        state = "untestable" if size < LEAST_MEMBERS else "degenerate" if size > MOST_SHARE * total else "tested"
        head = lambda state: [F.lit(name).alias("class"), F.lit(size).cast("long").alias("size"), F.lit(state).alias("state")]  # noqa: B023, E731
        if state == "tested":
            found = kept(_predicates(df, member, columns, notes, LEVELS).where(F.col("support").between(1, total - 1)), "predicates")
            chosen = best_predicates(found, total)
            per_column = [len(list(g)) for _, g in groupby(chosen, key=lambda r: r["column"])]
            levels_ = [ALPHA / max(n, 1) for n in (found.count(), sum(a * b for a, b in combinations(per_column, 2)))]
            least = -(math.lgamma(total + 1) - math.lgamma(size + 1) - math.lgamma(total - size + 1))  # the log of a perfect predicate's chance
            single = scored(found.where("hits > 0"), size, total)
            pair = scored(conjunctions(df, member, chosen).where(F.col("support") < total), size, total)
            one = single.agg(F.count_if("leaks").alias("n_leaks"), F.count_if(F.col("p_value") <= levels_[0]).alias("c1"), F.min_by(F.when(F.col("leaks"), F.concat_ws(" ", "column", "predicate")), F.struct((~F.col("leaks")).alias("w"), (-F.col("precision_bp") * F.col("recall_bp")).alias("l"), "p_value", "column", "predicate")).alias("best"))
            two = pair.agg(F.count_if("leaks").alias("n_pair_leaks"), F.count_if(F.col("p_value") <= levels_[1]).alias("c2"), F.count(F.lit(1)).alias("n_pairs"))
            powered = F.lit(least <= math.log(levels_[0])) | (F.lit(least <= math.log(levels_[1])) & (F.col("n_pairs") > 0))
            row = one.crossJoin(two).select(*head(None)[:2], F.when(powered, "tested").otherwise("underpowered").alias("state"), "n_leaks", "n_pair_leaks", (F.col("c1") + F.col("c2")).alias("n_certified"), "best")  # one row each
        else:
            nothing = [F.lit(0).cast("long").alias(c) for c in ("n_leaks", "n_pair_leaks", "n_certified")]
            row = df.sparkSession.range(1).select(*head(state), *nothing, F.lit(None).cast("string").alias("best"))
        out = row if out is None else out.unionByName(row)
    return out


def contained_columns(df: DataFrame, columns: list[str], least_bp: int = 9_500) -> DataFrame:
    """Columns whose text holds another column's text, or begins with one and goes on with a part of a second, in nearly all rows.

    One pass: each pair and each triple of columns is a count. Texts of fewer than four characters say nothing.
    """
    text_of = {c: F.when(F.length(F.col(c).cast("string")) >= 4, F.col(c).cast("string")) for c in columns}
    kinds = [(a, b, None) for a in columns for b in columns if a != b] + [(a, b, c) for a in columns for b in columns for c in columns if len({a, b, c}) == 3]

    def hit(a: str, b: str, c: str | None) -> Column:
        whole, first = text_of[a], text_of[b]
        if c is None:
            return F.contains(whole, first)
        tail = F.substring(whole, F.length(first) + 1, F.length(whole))
        return F.startswith(whole, first) & (F.length(tail) > 0) & F.contains(text_of[c], tail)

    counts = [F.count(text_of[a]).alias(f"n{k}") for k, (a, _, _) in enumerate(kinds)] + [F.count_if(hit(*x)).alias(f"h{k}") for k, x in enumerate(kinds)]
    name = lambda b, c: f"contains {b}" if c is None else f"{b} and a part of {c}"
    each = F.array(*(F.struct(F.lit(a).alias("column"), F.lit(name(b, c)).alias("derivation"), F.col(f"n{k}").alias("n"), F.col(f"h{k}").alias("hits")) for k, (a, b, c) in enumerate(kinds)))
    return df.agg(*counts).select(F.inline(each)).where(f"n > 0 AND hits * 10000 >= n * {least_bp}")


def parts_of(texts: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """``texts`` with ``part``: the parts of the column that have one of ``lengths``.

    Looking for values of these lengths within texts is then a join on equal values, and a text makes no more rows than it has
    characters for each length.
    """
    size = F.length(column)
    if not lengths:
        return texts.withColumn("part", F.lit(None).cast("string")).where("false")
    each = texts.where(size >= min(lengths)).withColumn("__l", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("__l") <= size)
    each = each.withColumn("__s", F.explode(F.sequence(F.lit(1), size - F.col("__l") + 1)))
    return each.withColumn("part", F.substring(column, F.col("__s"), F.col("__l"))).drop("__l", "__s")


def recoverable_columns(rows: DataFrame, lines: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the ledger with how many of their values (six characters or more) stand in some line's reference; two make them recoverable.

    Only lengths that values have are looked for, and none beyond the longest reference.
    """
    values = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("part")) for c in columns)))).where(F.length("part") >= 6).distinct()
    references = lines.select("reference").distinct()
    longest = references.agg(F.coalesce(F.max(F.length("reference")), F.lit(0)).alias("n")).first()["n"]
    lengths = sorted(r.n for r in values.select(F.length("part").alias("n")).distinct().where(F.col("n") <= longest).collect())
    seen = parts_of(references, "reference", lengths).select("part").distinct()
    n = values.join(seen, "part").groupBy("column").agg(F.count(F.lit(1)).alias("n_found"))
    return n.withColumn("recoverable", F.col("n_found") >= 2)


def posting_lags(rows: DataFrame, lines: DataFrame, most: int = 7) -> DataFrame:
    """Days from the nearest settlement day before a line's value date to that date, -1 beyond ``most``: lag, n_lines."""
    settled = rows.where("settled_at IS NOT NULL").select("entity", calendar.local_day(F.col("settled_at")).alias("day")).distinct()
    near = lines.select("entity", "bank_index", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"), "value_day").withColumn("day", F.col("value_day") - F.col("lag"))
    lag = near.join(settled, ["entity", "day"]).groupBy("entity", "bank_index").agg(F.min("lag").alias("lag"))
    return lines.select("entity", "bank_index").join(lag, ["entity", "bank_index"], "left").groupBy(F.coalesce("lag", F.lit(-1)).alias("lag")).agg(F.count(F.lit(1)).alias("n_lines"))


def derivable_references(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose reference holds the last six characters of a settlement of their entity."""
    ends = rows.where("length(settlement_id) >= 6").select("entity", F.substring("settlement_id", -6, 6).alias("part")).distinct()
    return parts_of(lines.select("entity", "bank_index", "reference"), "reference", [6]).join(ends, ["entity", "part"], "left_semi").select("entity", "bank_index", "reference").distinct()


def hypergeometric_tail(hits: int, drawn: int, members: int, total: int) -> float:
    """The chance of at least ``hits`` members among ``drawn`` of ``total``."""
    return float(hypergeometric_tails(np.array([hits]), np.array([drawn]), members, total)[0])


def _beyond_powers(n: np.ndarray) -> np.ndarray:
    """ln n! - (n ln n - n): small for any n, so that no digits go where such are subtracted."""
    few = np.array([math.lgamma(k + 1) - k * math.log(k) + k if k else 0.0 for k in range(16)])
    x = np.maximum(n, 16).astype(np.float64)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return np.where(n < 16, few[np.minimum(n, 15)], 0.5 * np.log(2 * math.pi * x) + series)


def _hypergeometric(k: np.ndarray, drawn: np.ndarray, members: int, total: int) -> np.ndarray:
    """The chance of just ``k`` members: the four cells of its table against those that are expected."""
    cells = [(k, drawn, members), (members - k, total - drawn, members), (drawn - k, drawn, total - members), (total - members - drawn + k, total - drawn, total - members)]
    far = (k * total - members * drawn) / total
    fixed = _beyond_powers(np.array([members, total - members])).sum() - _beyond_powers(np.array([total]))
    log = fixed + _beyond_powers(drawn) + _beyond_powers(total - drawn)
    for (seen, a, b), sign in zip(cells, (1, -1, -1, 1), strict=True):
        expected = np.maximum(a * (b / total), 1e-300)
        t = np.where(seen > 0, sign * far / expected, 0.0)
        log -= _beyond_powers(seen) + np.where(seen > 0, expected * ((1 + t) * np.log1p(t) - t), expected)
    return np.exp(log)


def hypergeometric_tails(hits: np.ndarray, drawn: np.ndarray, members: int, total: int) -> np.ndarray:
    """The chance of at least each of ``hits`` members among ``drawn`` of ``total``.

    Terms are added from the first one away from the mode, each by its ratio to the one before: upwards, or, up to the
    mode, those below, whose sum is taken from one. As ratios only fall, what is left out is known to be under 1e-17 of the
    sum. So a row takes a few terms if it is far out, and some ten standard deviations, the root of the draws, if it isn't.
    """
    hits, drawn = np.asarray(hits, np.int64), np.asarray(drawn, np.int64)
    out = np.ones(len(hits))
    out[hits > np.minimum(drawn, members)] = 0.0
    open_ = np.flatnonzero((hits > np.maximum(drawn + members - total, 0)) & (hits <= np.minimum(drawn, members)))
    up = hits[open_] > (drawn[open_] + 1) * (members + 1) // (total + 2)  # beyond the mode
    for upwards, at in ((True, open_[up]), (False, open_[~up])):
        n, k = drawn[at], hits[at] - (not upwards)
        first, sums = _hypergeometric(k, n, members, total), np.ones(len(at))
        place, x, n, term = np.arange(len(at)), k.astype(np.float64), n.astype(np.float64), np.ones(len(at))
        while len(place):
            for _ in range(16):
                ratio = (members - x) * (n - x) / ((x + 1) * (total - members - n + x + 1)) if upwards else x * (total - members - n + x) / ((members - x + 1) * (n - x + 1))
                term = term * np.maximum(ratio, 0.0)  # nought beyond the last term
                x += 1 if upwards else -1
                sums[place] += term
            more = (term > 0) & (term * ratio > 1e-17 * sums[place] * (1 - ratio))
            place, x, n, term = place[more], x[more], n[more], term[more]
        out[at] = first * sums if upwards else 1 - first * sums
    return out.clip(0.0, 1.0)


def assigned_pairs(costs: list[list[int]], limit: int = 10_000) -> list[tuple[int, int, int, bool]]:
    """The cheapest one-to-one assignment of rows to columns: (row, column, cost, accepted). Shortest augmenting paths with potentials."""
    n, m = len(costs), len(costs[0]) if costs else 0
    if n > m:
        return sorted((i, j, c, ok) for j, i, c, ok in assigned_pairs([list(r) for r in zip(*costs, strict=True)], limit))
    u, v, row_of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, done = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at] = True
            step, nxt = math.inf, 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                reduced = costs[row_of[at] - 1][j - 1] - u[row_of[at]] - v[j]
                if reduced < least[j]:
                    least[j], came[j] = reduced, at
                if least[j] < step:
                    step, nxt = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at:
            row_of[at], at = row_of[came[at]], came[at]
    return sorted((row_of[j] - 1, j - 1, costs[row_of[j] - 1][j - 1], costs[row_of[j] - 1][j - 1] <= limit) for j in range(1, m + 1) if row_of[j])


def nearest_pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` of the one-to-one pairing of the smaller side whose sums of differences cost least; both have two whole coordinates.

    Shortest augmenting paths with potentials, as ``assigned_pairs`` has them, but no table of costs: memory grows with the
    points. A path looks only at points whose first coordinate lies within the bound that the nearest free one sets, and once at points that are alike.
    """
    if len(left[0]) > len(right[0]):
        return nearest_pairs(right, left)[::-1]
    left, right = [np.asarray(x, np.int64) for x in left], [np.asarray(y, np.int64) for y in right]
    n, m, far = len(left[0]), len(right[0]), np.iinfo(np.int64).max // 2
    order = np.lexsort(right[::-1])
    y0, y1 = right[0][order], right[1][order]
    alike = np.unique(np.stack(left, axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    u, v, row_of, column_of = np.zeros(n, np.int64), np.zeros(m, np.int64), np.full(m, -1), np.full(n, -1)
    least, ahead, came = np.full(m, far), np.full(m, far), np.zeros(m, np.int64)
    for start in range(n):
        cost = np.abs(y0 - left[0][start]) + np.abs(y1 - left[1][start]) - v
        u[start] = cost.min()
        at, base, end, low, high, looked = start, 0, -1, m, 0, {}
        bound = int(cost[row_of < 0].min() - u[start])  # how far the nearest free point is by what is known
        while True:
            ahead_of = base - int(u[at])
            if ahead_of < looked.get(alike[at], far):
                looked[alike[at]] = ahead_of
                x = int(left[0][at])
                top, end_ = np.searchsorted(y0, (x - bound + ahead_of, x + bound - ahead_of + 1))
                cost = np.abs(y0[top:end_] - x) + np.abs(y1[top:end_] - left[1][at]) - v[top:end_] + ahead_of
                nearer = np.flatnonzero((cost < least[top:end_]) & (cost <= bound))
                if len(nearer):
                    cost, nearer = cost[nearer], nearer + top
                    least[nearer], came[nearer] = cost, at
                    low, high = min(low, top), max(high, end_)
                    free = row_of[nearer] < 0
                    ahead[nearer[~free]] = cost[~free]
                    if free.any() and (end < 0 or cost[free].min() < bound):
                        k = int(cost[free].argmin())
                        bound, end = int(cost[free][k]), int(nearer[free][k])
            j = low + int(ahead[low:high].argmin())
            if ahead[j] >= bound:
                break
            at, base = int(row_of[j]), int(ahead[j])
            ahead[j] = far
        met = low + np.flatnonzero(least[low:high] < bound)
        v[met] -= bound - least[met]
        u[row_of[met]] += bound - least[met]
        u[start] += bound
        least[low:high] = ahead[low:high] = far
        at = -1
        while at != start:
            at = int(came[end])
            row_of[end], column_of[at], end = at, end, int(column_of[at])
    return np.arange(n), order[column_of]


def cheapest_pairs(edges: list[tuple[object, object, int]], limit: int) -> list[tuple[object, object, int]]:
    """The one-to-one pairing among ``edges`` (left, right, cost) that costs least if a left one without a partner costs ``limit``.

    Each left one may also take a place of its own at that cost; one after the other gets the cheapest way to make room.
    """
    near: dict = {}
    for i, j, cost in edges:
        near.setdefault(i, {})[j] = min(cost, near.get(i, {}).get(j, cost))
    u: dict = {}
    v: dict = {}
    holder: dict = {}
    held: dict = {}
    for start in sorted(near):
        ways = lambda i: [*near[i].items(), ((None, i), limit)]
        u[start] = min(cost - v.get(j, 0) for j, cost in ways(start))
        least, came, done, closed, heap, at, base = {}, {}, [], set(), [], start, 0
        while True:
            for j, cost in ways(at):
                far = base + cost - u[at] - v.get(j, 0)
                if far < least.get(j, math.inf):
                    least[j], came[j] = far, at
                    heapq.heappush(heap, (far, str(j), j))
            far, _, j = heapq.heappop(heap)
            while j in closed:
                far, _, j = heapq.heappop(heap)
            closed.add(j)
            base = far
            if j not in holder:
                break
            done.append(j)
            at = holder[j]
        for k in done:
            v[k] = v.get(k, 0) - (base - least[k])
            u[holder[k]] += base - least[k]
        u[start] += base
        while True:
            i = came[j]
            holder[j], held[i], j = i, j, held.get(i)
            if i == start:
                break
    return sorted((i, j, near[i][j]) for i, j in held.items() if j in near[i])
