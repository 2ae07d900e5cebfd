"""The evidence-tiered resolver: one outcome for each bank line, declined unless the evidence singles one out.

Tier A follows the processor's report, tier B the amounts of settlements, tier C searches rows. Only a
verified line consumes its settlement, and a line can only consume a settlement of its own amount; so
the order-dependent fold runs within each (entity, amount), in parallel and on a few small rows,
however many lines an entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from . import joins, subsets, windows
from .storage import kept

#: The outcome vocabulary.
VERIFIED, DISCREPANCY, RECONSTRUCTED, AMBIGUOUS, UNRESOLVED = "verified", "discrepancy", "reconstructed", "ambiguous", "unresolved"


#: What a row says of its own settlement, which a blind search must not see.
WITHHELD = ["settlement_id", "settled", "settled_at", "settlement_utr"]


def withheld(rows: DataFrame) -> DataFrame:
    """Rows without what they say of their settlement."""
    return rows.drop(*WITHHELD)


def _facts(rows: DataFrame) -> DataFrame:
    """Net, size and last creation of each settlement."""
    return rows.where("settlement_id IS NOT NULL").groupBy("entity", "settlement_id").agg(
        F.sum(F.col("credit") - F.col("debit")).alias("net"), F.max("created_at").alias("last_created_at"))


def tiers_a_and_b(rows: DataFrame, lines: DataFrame, report: DataFrame) -> DataFrame:
    """entity, bank_index, amount, value_day, seq, tier, kind, reason, settlement_id, n_candidates; kind is null where tier C must decide."""
    facts = kept(_facts(rows), "facts")  # few next to the rows, and read twice
    back = joins.reversals(lines)
    marks = back.select("entity", F.col("credit_index").alias("bank_index"), F.lit("credit").alias("mark")).unionByName(
        back.select("entity", F.col("debit_index").alias("bank_index"), F.lit("debit").alias("mark")))
    x = joins.lines_to_report(windows.processing_order(lines), report).join(marks, ["entity", "bank_index"], "left")
    named = facts.withColumnsRenamed({"net": "named_net", "last_created_at": "named_last"})
    x = x.join(named, ["entity", "settlement_id"], "left")
    ceiling = calendar.end_of_day(F.col("value_day"))
    why = (
        F.when(F.col("amount") <= 0, F.when(F.col("mark") == "debit", "OTHER").otherwise("NOT_OUR_CREDIT"))
        .when(F.col("mark") == "credit", "CREDIT_REVERSED")
        .when(F.col("settlement_id").isNull(), None)
        .when(F.col("named_net").isNull() | (F.col("reported_amount") != F.col("amount")), "CLAIMED_CREDIT_NOT_ON_STATEMENT")
        .when(F.col("named_net") != F.col("amount"), "ATTESTED_COMPOSITION_DOES_NOT_CLOSE")
        .when(F.col("named_last") > ceiling, "TEMPORAL_IMPOSSIBILITY")
    )
    x = x.withColumn("why", why)
    line = F.struct("seq", "bank_index", "settlement_id", "why", "value_day", ceiling.alias("ceiling"))
    groups = x.groupBy("entity", "amount").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    own = facts.groupBy("entity", F.col("net").alias("amount")).agg(F.array_sort(F.collect_list(F.struct("settlement_id", "last_created_at"))).alias("settlements"))
    groups = groups.join(own, ["entity", "amount"], "left")
    none = F.lit(None).cast("string")
    result = "array<struct<bank_index:bigint,value_day:bigint,seq:bigint,tier:string,kind:string,reason:string,settlement_id:string,n_candidates:int>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(result).alias("out"))

    nothing = F.array().cast("array<struct<settlement_id:string,last_created_at:bigint>>")
    of_amount = F.coalesce("settlements", nothing)

    def decide(y, used, free):
        made = lambda tier, kind, reason, settlement, n: F.struct(
            y["bank_index"].alias("bank_index"), y["value_day"].alias("value_day"), y["seq"].alias("seq"), F.lit(tier).alias("tier"),
            (kind if not isinstance(kind, str) else F.lit(kind)).cast("string").alias("kind"), reason.alias("reason"), settlement.alias("settlement_id"), n.cast("int").alias("n_candidates"))
        late = free[0]["last_created_at"] > y["ceiling"]
        declined = F.when(y["why"].isin("OTHER", "NOT_OUR_CREDIT"), UNRESOLVED).otherwise(DISCREPANCY)
        return (
            F.when(y["why"].isNotNull(), made("A", declined, y["why"], y["settlement_id"], F.lit(0)))
            .when(y["settlement_id"].isNotNull() & F.array_contains(used, y["settlement_id"]), made("A", DISCREPANCY, F.lit("DOUBLE_ASSIGNMENT"), y["settlement_id"], F.lit(0)))
            .when(y["settlement_id"].isNotNull(), made("A", VERIFIED, none, y["settlement_id"], F.lit(1)))
            .when(F.size(free) == 0, made("C", none, none, none, F.lit(0)))
            .when(F.size(free) > 1, made("B", AMBIGUOUS, none, none, F.size(free)))
            .when(late, made("B", DISCREPANCY, F.lit("TEMPORAL_IMPOSSIBILITY"), free[0]["settlement_id"], F.lit(1)))
            .otherwise(made("B", VERIFIED, none, free[0]["settlement_id"], F.lit(1)))
        )

    # a lambda over an array of one value works it out once
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def step(state, y):
        free = F.filter(of_amount, lambda s: ~F.array_contains(state["used"], s["settlement_id"]))

        def after(out):
            used = F.when(out["kind"] == VERIFIED, F.concat(state["used"], F.array(out["settlement_id"]))).otherwise(state["used"])
            return F.struct(used.alias("used"), F.concat(state["out"], F.array(out)).alias("out"))

        return once(once(free, lambda left: decide(y, state["used"], left)), after)

    # a line that is alone needs no fold
    alone = F.array(decide(F.col("lines")[0], F.array().cast("array<string>"), of_amount)).cast(result)
    every = F.when(F.size("lines") == 1, alone).otherwise(F.aggregate("lines", start, step, lambda s: s["out"]))
    folded = groups.select("entity", "amount", F.explode(every).alias("o"))
    return folded.select("entity", "amount", "o.*")


def _own(rows: DataFrame, consumed: DataFrame) -> DataFrame:
    """Rows that can ever be in a pool: net not zero, captured; when they count from, and the line that consumed them."""
    net = F.col("credit") - F.col("debit")
    return rows.join(consumed, ["entity", "settlement_id"], "left").select(
        "entity", "row_id", net.alias("net"), "created_at", "used_seq",
        F.when(F.col("type") == "payment", calendar.eligible_at(F.col("created_at"))).otherwise(F.col("created_at")).alias("from_at"),
        ((F.col("type") != "payment") | (F.col("credit") != 0)).alias("captured")).where("net <> 0 AND captured")


def _unconsumed(rows: DataFrame) -> DataFrame:
    """No settlement of the rows is consumed."""
    return rows.select("entity", "settlement_id", F.lit(None).cast("long").alias("used_seq")).limit(0)


def pool_bounds(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """entity, bank_index and how many rows its pool has at most, from counts by entity and day: no line meets a row."""
    # a row counts for a day's lines if it is there by the day's end, which is inclusive
    day = F.call_function("div", F.col("from_at") + (calendar.OFFSET - 1), F.lit(86_400))
    counts = _own(rows, _unconsumed(rows)).groupBy("entity", day.alias("value_day")).agg(F.count(F.lit(1)).alias("n"))
    asked = lines.select("entity", "value_day", F.lit(0).cast("long").alias("n")).distinct()
    days = counts.unionByName(asked).groupBy("entity", "value_day").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("entity").orderBy("value_day").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("entity", "bank_index", "value_day").join(days.select("entity", "value_day", upto.alias("bound")), ["entity", "value_day"]).select("entity", "bank_index", "bound")


def eligible_pool(rows: DataFrame, lines: DataFrame, consumed: DataFrame, closing: bool = False) -> DataFrame:
    """Rows that a line may draw on: made and eligible by its day's end, net not zero, and not consumed by an earlier line.

    ``lines``: entity, bank_index, amount, value_day, seq; ``consumed``: entity, settlement_id, used_seq. With
    ``closing`` only rows that are the line's amount by themselves, which Spark finds by an equi-join.
    """
    ceiling = calendar.end_of_day(F.col("value_day"))
    both = (F.col("l.entity") == F.col("r.entity")) & (F.col("r.created_at") <= ceiling) & (F.col("r.from_at") <= ceiling) & (F.col("r.used_seq").isNull() | (F.col("r.used_seq") >= F.col("l.seq")))
    both = both & (F.col("r.net") == F.col("l.amount")) if closing else both
    pool = lines.alias("l").join(_own(rows, consumed).alias("r"), both, "inner" if closing else "left")
    return pool.select("l.entity", "l.bank_index", F.col("l.amount").alias("target"), "r.row_id", "r.net")


def searched(rows: DataFrame, lines: DataFrame, consumed: DataFrame, max_pool: int = subsets.MAX_POOL, **limits) -> DataFrame:
    """Candidates of each line among the rows that it may draw on; pools are counted before any is made.

    No pool has more rows than its entity, so where no entity has more than ``max_pool`` days needn't be counted.
    """
    total = _own(rows, _unconsumed(rows)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    if kept(total.where(F.col("n") > max_pool), "large-entities").isEmpty():
        lines = lines.where("entity IS NOT NULL AND value_day IS NOT NULL")
        return subsets.enumerate_lines(eligible_pool(rows, lines, consumed), max_pool=None, **limits)
    bounds = kept(pool_bounds(rows, lines), "pool-bounds")
    small = lines.join(bounds.where(F.col("bound") <= max_pool).select("entity", "bank_index"), ["entity", "bank_index"], "left_semi")
    large = lines.join(bounds.where(F.col("bound") > max_pool).select("entity", "bank_index"), ["entity", "bank_index"], "left_semi")
    found = subsets.enumerate_lines(eligible_pool(rows, small, consumed), max_pool=None, **limits)
    single = eligible_pool(rows, large, consumed, closing=True).select("entity", "bank_index", "row_id", "net")
    return found.unionByName(subsets.single_rows(large.select("entity", "bank_index"), single, limits.get("cap", subsets.CAP)))


def consumed_by(decided: DataFrame) -> DataFrame:
    """entity, settlement_id, used_seq: which line consumed a settlement."""
    return decided.where(F.col("kind") == VERIFIED).select("entity", "settlement_id", F.col("seq").alias("used_seq"))


def tier_c(rows: DataFrame, decided: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the lines that tiers A and B leave open, and their candidates."""
    open_ = decided.where("kind IS NULL")
    found = kept(searched(rows, open_, consumed_by(decided), **limits), "candidates")
    rivals = windows.rivals(decided.select("entity", "bank_index", "amount", "value_day"), decided.where(F.col("kind") == VERIFIED))
    t = found.groupBy("entity", "bank_index").agg(F.count("candidate").cast("int").alias("n"), F.every("complete").alias("complete")).join(rivals, ["entity", "bank_index"])
    kind = F.when(F.col("n") > 1, AMBIGUOUS).when((F.col("n") == 1) & F.col("complete") & (F.col("rivals") == 0), RECONSTRUCTED).otherwise(UNRESOLVED)
    reason = F.when((F.col("n") == 0) & F.col("complete"), "NO_SUBSET_CLOSES").when((F.col("n") <= 1) & ~F.col("complete"), "ENUMERATION_TRUNCATED").when((F.col("n") == 1) & (F.col("rivals") > 0), "OTHER")
    t = t.select("entity", "bank_index", kind.alias("c_kind"), reason.alias("c_reason"), F.col("n").alias("c_n"))
    out = open_.join(t, ["entity", "bank_index"]).withColumns({"kind": F.col("c_kind"), "reason": F.col("c_reason"), "n_candidates": F.col("c_n")})
    return out.select(*decided.columns), found


def rival_closures(rows: DataFrame, decided: DataFrame, **limits) -> DataFrame:
    """entity, bank_index, rivals, lower_bound of each verified line: how many sets of rows would explain its amount as well.

    The pool is that before the line consumed its own settlement; the claimed set is one of the rivals,
    so there is one at least. A search that isn't complete gives a lower bound and says so.
    """
    verified = decided.where(F.col("kind") == VERIFIED)
    found = searched(rows, verified, consumed_by(decided), **limits)
    return found.groupBy("entity", "bank_index").agg(
        F.greatest(F.count("candidate"), F.lit(1)).alias("rivals"), (~F.every("complete")).alias("lower_bound"))


def compositions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Credit and debit rows of each verified line with their totals; rows of net zero belong to neither side."""
    net = F.col("credit") - F.col("debit")
    own = rows.where("settlement_id IS NOT NULL").select("entity", "settlement_id", "row_id", net.alias("net"))
    of = decided.where(F.col("kind") == VERIFIED).select("entity", "bank_index", "settlement_id").join(own, ["entity", "settlement_id"])
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("row_id"))))
    total = lambda c: F.sum(F.when(c, F.col("net")).otherwise(0))
    return of.groupBy("entity", "bank_index").agg(
        side(F.col("net") > 0).alias("credit_ids"), side(F.col("net") < 0).alias("debit_ids"), total(F.col("net") > 0).alias("credit_total"), (-total(F.col("net") < 0)).alias("debit_total"))


def attested_rows(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows that the report attests to a discrepant line, and whether each offends: it was made after the line's day."""
    own = rows.where("settlement_id IS NOT NULL").select("entity", "settlement_id", "row_id", "created_at")
    of = decided.where((F.col("kind") == DISCREPANCY) & F.col("settlement_id").isNotNull()).select("entity", "bank_index", "settlement_id", "reason", "value_day")
    late = F.col("created_at") > calendar.end_of_day(F.col("value_day"))
    return of.join(own, ["entity", "settlement_id"]).select("entity", "bank_index", "reason", "row_id", ((F.col("reason") == "TEMPORAL_IMPOSSIBILITY") & late).alias("offends"))


def resolve(rows: DataFrame, lines: DataFrame, report: DataFrame, **limits) -> DataFrame:
    """One outcome per line after all three tiers and the withdrawal of reconstructions that share rows."""
    decided = kept(tiers_a_and_b(rows, lines, report), "decided")
    c, found = tier_c(rows, decided, **limits)
    c = kept(c, "tier-c")
    claims = (
        found.where("candidate IS NOT NULL").join(c.where(F.col("kind") == RECONSTRUCTED).select("entity", "bank_index"), ["entity", "bank_index"], "left_semi")
        .select("entity", "bank_index", F.explode(F.split("row_ids", "[|]")).alias("row_id"), F.lit(False).alias("verified")))
    assigned = decided.where(F.col("kind") == VERIFIED).join(rows.where("settlement_id IS NOT NULL").select("entity", "settlement_id", "row_id"), ["entity", "settlement_id"])
    claims = claims.unionByName(assigned.select("entity", "bank_index", "row_id", F.lit(True).alias("verified")))
    lost = windows.collisions(claims).where("NOT keeps").select("entity", "bank_index", F.lit(True).alias("lost"))
    every = decided.where("kind IS NOT NULL").unionByName(c).join(lost, ["entity", "bank_index"], "left")
    gone = F.coalesce("lost", F.lit(False))
    return every.withColumns({"kind": F.when(gone, UNRESOLVED).otherwise(F.col("kind")), "reason": F.when(gone, "OTHER").otherwise(F.col("reason"))}).drop("lost")


def first_cause(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """For each row of a settlement that an unverified line names: the first such line."""
    named = outcomes.where((F.col("kind") != VERIFIED) & F.col("settlement_id").isNotNull()).select("entity", "settlement_id", "bank_index")
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("entity", "settlement_id").orderBy("bank_index"))).where("n = 1").drop("n")
    done = outcomes.where(F.col("kind") == VERIFIED).select("entity", "settlement_id")
    return rows.join(done, ["entity", "settlement_id"], "left_anti").join(named, ["entity", "settlement_id"]).select("entity", "row_id", F.col("bank_index").alias("caused_by"))
