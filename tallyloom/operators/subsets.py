"""Subset sums: every set of rows that adds up to a bank line, with an honest account of completeness.

``closures`` searches one pool within bounds of memory and work. ``complete`` is true only if the whole space was
searched; a reached cap or spent bound makes it false even where the count would be right, and what was found stays.
The bounds count work, never time, so results repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import closures

#: Candidates listed at most, sums of a half of a pool that is searched whole, and rows of a pool that are gathered at all.
CAP, BUDGET, MAX_POOL = 200, 1 << 21, 4096
#: The cascade's own cap.
CASCADE_CAP = 32
RESULT = "entity long, bank_index long, candidate int, row_ids string, n_debits int, credit long, complete boolean, status string"


def closing_subsets(ids: list[str], nets: list[int], target: int, cap: int = CAP, budget: int = BUDGET, most_debits: bool = False) -> tuple[list[tuple[str, ...]], bool, str]:
    """(sorted subsets with that sum, complete, status). The empty set closes only a target of 0 over an empty pool.

    With ``most_debits`` only subsets with as many negative rows as any of them has; the cap counts these alone.
    """
    if not ids:
        return ([()] if target == 0 else []), True, "empty_pool"
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    found, complete, status = closures.search([int(nets[i]) for i in order], target, cap, budget, most_debits)
    return sorted(tuple(ids[order[k]] for k in s) for s in found), complete, status


def closing_subsets_many(pools: list[tuple[list[str], list[int], int]], cap: int = CAP, budget: int = BUDGET, most_debits: bool = False) -> list[tuple[list[tuple[str, ...]], bool, str]]:
    """``closing_subsets`` of many pools (ids, nets, target); those of few rows are searched together."""
    small = closures.small_many([nets for _, nets, _ in pools], [target for _, _, target in pools], cap, budget, most_debits)
    return [
        closing_subsets(ids, nets, target, cap, budget, most_debits) if found is None else (sorted(tuple(sorted(ids[k] for k in s)) for s in found), True, "exhausted")
        for (ids, nets, target), found in zip(pools, small, strict=True)]


def enumerate_lines(pools: DataFrame, cap: int = CAP, budget: int = BUDGET, max_pool: int | None = MAX_POOL, most_debits: bool = False) -> DataFrame:
    """Candidates of each line: ``pools`` has entity, bank_index, target, row_id, net (row_id null: an empty pool).

    A pool of more than ``max_pool`` rows isn't gathered: its single rows are tried by a comparison, and
    the search counts as incomplete. Without ``max_pool`` the caller vouches for the pools' size.
    """
    if max_pool is None:
        return _gathered(pools, cap, budget, most_debits)
    sizes = pools.groupBy("entity", "bank_index").agg(F.count("row_id").alias("size"))
    small = pools.join(sizes.where(F.col("size") <= max_pool).select("entity", "bank_index"), ["entity", "bank_index"], "left_semi")
    large = sizes.where(F.col("size") > max_pool).select("entity", "bank_index")
    single = pools.where("net = target").select("entity", "bank_index", "row_id", "net")
    return _gathered(small, cap, budget, most_debits).unionByName(single_rows(large, single, cap))


def single_rows(lines: DataFrame, closing: DataFrame, cap: int = CAP) -> DataFrame:
    """Lines whose pool is too large to be gathered, with the rows (entity, bank_index, row_id, net) that close them alone."""
    first = F.row_number().over(Window.partitionBy("entity", "bank_index").orderBy("row_id")) - 1
    some = lines.join(closing, ["entity", "bank_index"], "left").withColumn("k", first.cast("int")).where(F.col("k") < cap)
    one = F.col("row_id").isNotNull()
    return some.select(
        "entity", "bank_index", F.when(one, F.col("k")).alias("candidate"), F.col("row_id").alias("row_ids"), F.when(one, (F.col("net") < 0).cast("int")).alias("n_debits"),
        F.when(one, F.greatest("net", F.lit(0).cast("long"))).alias("credit"), F.lit(False).alias("complete"), F.lit("pool_too_large").alias("status"))


def numbers(column: pa.Array, null: int | None = None) -> list[int]:
    """A column of whole numbers as Python's, many times faster than one by one."""
    whole = column if null is None else pc.fill_null(column, null)
    return whole.to_pylist() if whole.null_count else whole.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.ListArray, values) -> list[list]:
    """A column of lists as Python's; their values are turned together."""
    flat, ends = values(column.flatten()), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum().tolist()
    return [flat[start:end] for start, end in zip([0, *ends], ends, strict=False)]


def _together(pools: list[list], most: int = 1 << 17) -> Iterator[slice]:
    """Runs of pools that have ``most`` rows in all, or are one pool."""
    start = rows = 0
    for k, pool in enumerate(pools):
        if k > start and rows + len(pool) > most:
            yield slice(start, k)
            start, rows = k, 0
        rows += len(pool)
    if start < len(pools):
        yield slice(start, len(pools))


def _gathered(pools: DataFrame, cap: int, budget: int, most_debits: bool) -> DataFrame:
    # lines as rows with their bounded pools: a batch of lines goes to Python at a time, not a group
    gathered = pools.groupBy("entity", "bank_index").agg(
        F.max("target").alias("target"), F.sort_array(F.collect_list(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "net")))).alias("pool"))
    gathered = gathered.select("entity", "bank_index", "target", F.col("pool.row_id").alias("ids"), F.col("pool.net").alias("nets"))

    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities, indexes, targets = (batch[c].to_pylist() for c in ("entity", "bank_index", "target"))
            ids, nets = _lists(batch["ids"], lambda x: x.to_numpy(zero_copy_only=False).tolist()), _lists(batch["nets"], numbers)
            for part in _together(ids):
                own = [dict(zip(i, map(int, n), strict=True)) for i, n in zip(ids[part], nets[part], strict=True)]
                found_of = closing_subsets_many([(list(net), list(net.values()), int(target)) for net, target in zip(own, targets[part], strict=True)], cap, budget, most_debits)
                out = []
                for entity, bank_index, net, (found, complete, status) in zip(entities[part], indexes[part], own, found_of, strict=True):
                    out += [(entity, bank_index, k, "|".join(s), sum(net[i] < 0 for i in s), sum(max(0, net[i]) for i in s), complete, status) for k, s in enumerate(found)]
                    if not found:
                        out.append((entity, bank_index, None, None, None, None, complete, status))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return gathered.mapInArrow(run, RESULT)


def fewest_deferred(pools: DataFrame, cap: int = CASCADE_CAP, **limits) -> DataFrame:
    """Candidates of each line with as many debits as any of them has; the cap counts these alone."""
    return enumerate_lines(pools, cap, most_debits=True, **limits)


def verdicts(candidates: DataFrame) -> DataFrame:
    """One row per line: determinate needs one candidate of a complete search."""
    n = F.count("candidate")
    t = candidates.groupBy("entity", "bank_index").agg(n.alias("n_candidates"), F.every("complete").alias("complete"))
    verdict = F.when(F.col("n_candidates") == 0, "unresolved").when(F.col("n_candidates") > 1, "ambiguous").when(F.col("complete"), "determinate").otherwise("unresolved")
    return t.withColumn("verdict", verdict)


def common_and_contested(candidates: DataFrame) -> DataFrame:
    """Rows in all candidates of a line (none unless the search was complete), and rows in only some."""
    split = candidates.where("candidate IS NOT NULL").select("entity", "bank_index", "candidate", "complete", F.explode(F.split("row_ids", "[|]")).alias("row_id"))
    k = candidates.groupBy("entity", "bank_index").agg(F.count("candidate").alias("k"))
    rows = split.groupBy("entity", "bank_index", "row_id").agg(F.count(F.lit(1)).alias("in"), F.every("complete").alias("complete")).join(k, ["entity", "bank_index"])
    common = (F.col("in") == F.col("k")) & F.col("complete")
    return rows.groupBy("entity", "bank_index").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(common, F.col("row_id")))), "|").alias("common"),
        F.array_join(F.array_sort(F.collect_list(F.when(~common, F.col("row_id")))), "|").alias("contested"))


def largest_under_cap(ids: list[str], nets: list[int], cap: int, ties: int = 64, budget: int = BUDGET) -> tuple[int | None, list[tuple[str, ...]], bool]:
    """The largest subset sum found that doesn't exceed ``cap``, up to ``ties`` subsets that reach it, and whether no larger one exists."""
    best, proven = closures.largest([int(n) for n in nets], cap, budget)
    return best, [] if best is None else closing_subsets(ids, nets, best, ties, budget)[0], proven


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of each line with the same rows on both sides, once."""
    return candidates.where("candidate IS NOT NULL").dropDuplicates(["entity", "bank_index", "row_ids"])


def largest_subsets(pools: DataFrame, ties: int = 64, budget: int = BUDGET) -> DataFrame:
    """The largest sum of each line's pool that doesn't exceed its target, up to ``ties`` sets that reach it, and whether it is proven."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            out = []
            for entity, bank_index, target, ids, nets in zip(lines.entity, lines.bank_index, lines.target, lines.ids, lines.nets, strict=True):
                best, found, proven = largest_under_cap(list(ids), list(map(int, nets)), int(target), ties, budget)
                out += [(entity, bank_index, best, "|".join(s), proven) for s in found] or [(entity, bank_index, best, "", proven)]
            yield pd.DataFrame(out, columns=["entity", "bank_index", "best", "row_ids", "proven"]).astype({"best": "Int64"})

    pool = F.sort_array(F.collect_list(F.struct("row_id", "net")))
    gathered = pools.groupBy("entity", "bank_index").agg(F.max("target").alias("target"), pool.alias("pool")).select("entity", "bank_index", "target", F.col("pool.row_id").alias("ids"), F.col("pool.net").alias("nets"))
    return gathered.mapInPandas(run, "entity long, bank_index long, best long, row_ids string, proven boolean")
