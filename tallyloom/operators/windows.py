"""Ordered operators: processing order, rivals, collisions, gaps, folds and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def processing_order(lines: DataFrame) -> DataFrame:
    """Lines by value date, then by place in the file: ranks within a day, shifted by the lines of the days before."""
    days = lines.groupBy("entity", "value_day").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("entity").orderBy("value_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("entity", "value_day", F.coalesce(earlier, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("entity", "value_day").orderBy("bank_index"))
    return lines.withColumn("__k", within).join(days, ["entity", "value_day"]).withColumn("seq", (F.col("__before") + F.col("__k")).cast("long")).select(*lines.columns, "seq")


def rivals(lines: DataFrame, verified: DataFrame) -> DataFrame:
    """Other credits of the same amount that no earlier verified line explains."""
    credit = processing_order(lines).where("amount > 0").join(verified.select("entity", "bank_index", F.lit(1).alias("v")), ["entity", "bank_index"], "left")
    same = Window.partitionBy("entity", "amount")
    before = same.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return credit.select("entity", "bank_index", (F.count(F.lit(1)).over(same) - F.coalesce(F.sum("v").over(before), F.lit(0)) - 1).alias("rivals"))


def collisions(claims: DataFrame) -> DataFrame:
    """Lines that claim a row which another line claims too, and whether they keep it: a single verified claim wins, else none does."""
    row = Window.partitionBy("entity", "row_id")
    contested = claims.withColumn("n", F.size(F.collect_set("bank_index").over(row))).where("n > 1").withColumn("wins", F.sum(F.col("verified").cast("int")).over(row))
    keeps = F.min(F.col("verified") & (F.col("wins") == 1))
    return contested.groupBy("entity", "bank_index").agg(F.count_distinct("row_id").alias("n_contested"), keeps.alias("keeps"))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of each line: more debits first, then larger credit, then rows; only over a complete set."""
    order = Window.partitionBy("entity", "bank_index").orderBy(F.desc("n_debits"), F.desc("credit"), "row_ids")
    return candidates.where("complete").withColumn("rank", F.row_number().over(order))


def dense_references(df: DataFrame, key: str, number: str) -> DataFrame:
    """Whether the sorted numbers of each key follow each other without a gap."""
    step = F.lead(number).over(Window.partitionBy(key).orderBy(number)) - F.col(number)
    return df.withColumn("step", step).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.every(F.col("step") == 1), F.lit(True)).alias("dense"))


def fifo_under_cap(df: DataFrame, key: str, order: list[str], amount: str, item: str, cap: int) -> DataFrame:
    """Oldest first, taking each item that still fits under the cap and passing over those that don't: key, item, total so far.

    What fits depends on all items before, so a key is one sorted run; it streams through a task, which
    keeps one total and never the items.
    """
    import pyarrow as pa

    def run(batches):
        at, total = None, 0
        for batch in batches:
            taken, totals = [], []
            for k, (owner, value) in enumerate(zip(batch[key].to_pylist(), batch["__amount"].to_pylist(), strict=True)):
                if owner != at:
                    at, total = owner, 0
                if total + value <= cap:
                    total += value
                    taken.append(k)
                    totals.append(total)
            rows = batch.take(pa.array(taken, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows[key], rows[item], pa.array(totals, pa.int64())], names=[key, item, "total"])

    few = df.select(key, *(c for c in order if c not in (key, item)), item, F.col(amount).cast("long").alias("__amount"))
    kinds = {c: few.schema[c].dataType.simpleString() for c in (key, item)}
    return few.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{key} {kinds[key]}, {item} {kinds[item]}, total long")


def fingerprints(df: DataFrame, key: str, chunk: Column, line: Column) -> DataFrame:
    """One digest of a key's lines in order: of the digests of its chunks, so that no value holds all lines."""
    parts = df.select(key, chunk.alias("__c"), line.alias("__l")).groupBy(key, "__c").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__l")), "|"), 256).alias("__d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__c", "__d"))), lambda x: x["__d"]), "|")
    return parts.groupBy(key).agg(F.sha2(whole, 256).alias("fingerprint"))


def debits_deferred(rows: DataFrame) -> DataFrame:
    """How many of a settlement's largest debits must wait for its payout not to be negative."""
    largest = Window.partitionBy("entity", "settlement_id").orderBy(F.desc("debit"), "row_id")
    whole = Window.partitionBy("entity", "settlement_id")
    own = rows.where("settlement_id IS NOT NULL").withColumn("payout", F.sum(F.col("credit") - F.col("debit")).over(whole))
    d = own.where("debit > 0").withColumn("n", F.row_number().over(largest)).withColumn("back", F.sum("debit").over(largest.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("payout < 0 AND payout + back >= 0").groupBy("entity", "settlement_id").agg(F.min("n").cast("long").alias("n_deferred"), F.max("payout").alias("payout"))


def separators(df: DataFrame, column: str, member: str) -> DataFrame:
    """How many of a class stand among the N lowest and the N highest of a column, N being the class's size.

    Ranks come from counts by value, which are summed before they are ordered, not from one sorted task.
    """
    by_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(member)).alias("m"))
    total = F.broadcast(by_value.agg(F.sum("m").alias("size"), F.sum("n").alias("all")))
    ranked = _running(by_value, column)
    t = ranked.crossJoin(total)  # one row
    return t.agg(F.max("size").alias("size"), F.sum(F.when(F.col("upto") <= F.col("size"), F.col("m")).otherwise(0)).alias("in_lowest"),
                 F.sum(F.when(F.col("all") - F.col("upto") + F.col("n") <= F.col("size"), F.col("m")).otherwise(0)).alias("in_highest"))


def _running(by_value: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``by_value`` with ``upto``, the rows at or below each value: range parts in parallel, then their offsets."""
    bounds = sorted(set(by_value.approxQuantile(column, [k / parts for k in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)
    dealt = by_value.withColumn("__p", part)  # the same part each time, unlike a sampled range partitioning
    sums = dealt.groupBy("__p").agg(F.sum("n").alias("__s"))
    before = sums.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.sum("n").over(Window.partitionBy("__p").orderBy(column))
    return dealt.join(F.broadcast(before), "__p").withColumn("upto", F.col("__b") + inside).drop("__p", "__b")


def ks_distance(df: DataFrame, column: str, member: str) -> DataFrame:
    """The largest gap between the distributions of a column inside and outside of a class, in millionths."""
    v = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_if(F.expr(member)).alias("n"), F.count_if(F.expr(f"NOT ({member})")).alias("o"))
    a = _running(v.select(column, "n"), column).select(column, F.col("upto").alias("a"))
    b = _running(v.select(column, F.col("o").alias("n")), column).select(column, F.col("upto").alias("b"))
    total = F.broadcast(v.agg(F.sum("n").alias("na"), F.sum("o").alias("nb")))
    gap = F.abs(F.call_function("div", F.col("a") * 1_000_000, F.col("na")) - F.call_function("div", F.col("b") * 1_000_000, F.col("nb")))
    return a.join(b, column).crossJoin(total).agg(F.max(gap).alias("ks_millionths"))
