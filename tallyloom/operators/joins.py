"""Joins between ledger, bank, report and order book. All keep the entity as a key, so books never mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .storage import kept


def last_by(df: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) in file order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order) if first else F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def batches_to_bank(settled: DataFrame, lines: DataFrame) -> DataFrame:
    """Settlements joined with the bank line of their reference; among equal references the last line counts."""
    one = last_by(lines.where("reference <> ''"), ["entity", "reference"], "bank_index")
    return settled.join(one, ["entity", "reference"]).select("entity", "settlement_id", "reference", "bank_index", "net", F.col("amount").alias("bank_amount"))


def ledger_to_erp(rows: DataFrame, erp: DataFrame) -> DataFrame:
    """entity, status, order_id: matched payments, payments without an order, orders without a payment."""
    paid = rows.where("type = 'payment' AND fee IS NOT NULL").select("entity", "order_id")
    known = erp.select("entity", "order_id")
    joinable = rows.where("type = 'payment'").select("entity", "order_id")
    tag = lambda df, status: df.select("entity", F.lit(status).alias("status"), "order_id")
    return (
        tag(paid.join(known, ["entity", "order_id"], "left_semi"), "matched")
        .unionByName(tag(paid.join(known, ["entity", "order_id"], "left_anti"), "without_order"))
        .unionByName(tag(known.join(joinable, ["entity", "order_id"], "left_anti"), "without_payment"))
    )


def lines_to_report(lines: DataFrame, report: DataFrame) -> DataFrame:
    """Each line with the settlement that the report names for its reference; the last row of the file counts."""
    named = last_by(report, ["entity", "reported_reference"], "file_position")
    named = named.select("entity", F.col("reported_reference").alias("reference"), "settlement_id", "reported_amount")
    return lines.join(named.where("reference <> ''"), ["entity", "reference"], "left")


def settlements_by_amount(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """Credit lines with the settlements of the same net: bank_index, n_matches, settlement_ids."""
    credit = lines.where("amount > 0")
    hits = credit.join(settled, (credit["entity"] == settled["entity"]) & (credit["amount"] == settled["net"]))
    return hits.groupBy(credit["entity"], "bank_index").agg(
        F.count(F.lit(1)).alias("n_matches"), F.concat_ws(",", F.array_sort(F.collect_list("settlement_id"))).alias("settlement_ids"))


def within_tolerance(lines: DataFrame, settled: DataFrame, days: int = 1) -> DataFrame:
    """Band join: amounts within one paisa per row and dates within ``days``, as an equi-join on day and amount bands.

    A settlement stands in the bands of its day and both neighbours, so each pair meets once.
    """
    width = 1 << 20
    spread = settled.withColumn("value_day", F.explode(F.array(*(F.col("expected_day") + d for d in range(-days, days + 1)))))
    spread = spread.withColumn("band", F.explode(F.array_distinct(F.array(
        F.floor((F.col("net") - F.col("n_rows")) / width), F.floor((F.col("net") + F.col("n_rows")) / width)))))
    lines = lines.withColumn("band", F.floor(F.col("amount") / width))
    hits = lines.join(spread, ["entity", "value_day", "band"]).where(F.abs(F.col("net") - F.col("amount")) <= F.col("n_rows"))
    return hits.select("entity", "bank_index", "settlement_id", (F.col("net") - F.col("amount")).alias("difference")).withColumn(
        "n_candidates", F.count(F.lit(1)).over(Window.partitionBy("entity", "bank_index")))


def conflict_components(lines: DataFrame, settled: DataFrame, width: int = 1 << 20) -> DataFrame:
    """entity, bank_index, component: lines of two components have no settlement within tolerance in common.

    A line is a point on its entity's axis of amounts and a settlement the interval of its tolerance; where no interval
    reaches the next one, a component ends. An axis is cut into bands of ``width``: a band's items are one sorted run,
    and how far the bands before reach comes from one row a band, so no task meets a whole entity.
    """
    points = lines.select("entity", F.col("amount").alias("low"), F.col("amount").alias("high"), "bank_index")
    reach = settled.select("entity", (F.col("net") - F.col("n_rows")).alias("low"), (F.col("net") + F.col("n_rows")).alias("high"), F.lit(None).cast("long").alias("bank_index"))
    items = points.unionByName(reach).withColumn("band", F.floor(F.col("low") / width))
    before = Window.partitionBy("entity").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = items.groupBy("entity", "band").agg(F.max("high").alias("reached")).withColumn("carried", F.max("reached").over(before)).drop("reached")
    order = Window.partitionBy("entity", "band").orderBy("low", "high")
    earlier = F.greatest(F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), "carried")
    begun = items.join(bands, ["entity", "band"]).withColumn("begins", F.when(earlier.isNull() | (F.col("low") > earlier), F.col("low")))
    last = begun.groupBy("entity", "band").agg(F.max("begins").alias("last")).withColumn("open", F.max("last").over(before)).drop("last")
    upto = Window.partitionBy("entity", "band").orderBy("low").rangeBetween(Window.unboundedPreceding, 0)  # with all that begin at the same place
    component = F.coalesce(F.max("begins").over(upto), "open")
    return begun.join(last, ["entity", "band"]).select("entity", "bank_index", component.alias("component")).where("bank_index IS NOT NULL")


def greedy_matches(near: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """entity, bank_index, settlement_id: lines in file order, each taking its settlement if just one is left for it.

    A taken settlement is gone for the lines after, so lines that may want the same ones are taken in order: the pairs
    of each component (entity, bank_index, component; an entity without them) are one sorted run that streams through
    a task, whose state is what this component has taken. However long a chain of lines is, the jobs are the same.
    """
    import pyarrow as pa

    pairs = near.select("entity", "bank_index", "settlement_id")
    if components is None:
        pairs = pairs.withColumn("component", F.lit(0).cast("long"))
    else:
        pairs = pairs.join(components, ["entity", "bank_index"])
    kinds = {f.name: f.dataType.simpleString() for f in near.schema}

    def run(batches):
        at, line, left, taken = None, None, [], set()

        def settle():
            if len(left) == 1:
                taken.add(left[0])
                return [(*line, left[0])]
            return []

        for batch in batches:
            out = []
            for entity, component, index, settlement in zip(*(batch[c].to_pylist() for c in ("entity", "component", "bank_index", "settlement_id")), strict=True):
                if line != (entity, index):
                    out += settle()
                    if at != (entity, component):
                        at, taken = (entity, component), set()
                    line, left = (entity, index), []
                if settlement not in taken and settlement not in left:
                    left.append(settlement)
            yield made(out, batch)
        if line is not None:
            yield made(settle(), batch)

    def made(out, batch):
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(n).type) for c, n in zip(columns, ("entity", "bank_index", "settlement_id"), strict=True)], names=["entity", "bank_index", "settlement_id"])

    ordered = pairs.repartition("entity", "component").sortWithinPartitions("entity", "component", "bank_index", "settlement_id")
    return ordered.mapInArrow(run, f"entity {kinds['entity']}, bank_index {kinds['bank_index']}, settlement_id {kinds['settlement_id']}")


def tolerant_matches(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """``greedy_matches`` of all lines and settlements within tolerance.

    A line and a settlement that only have each other match whatever the order; the others are taken in order, by
    components of what they alone may want.
    """
    near = within_tolerance(lines, settled).withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("entity", "settlement_id")))
    near = kept(near.select("entity", "bank_index", "settlement_id", "n_candidates", "n_lines"), "near")
    alone = near.where("n_candidates = 1 AND n_lines = 1").select("entity", "bank_index", "settlement_id")
    shared = near.where("n_candidates > 1 OR n_lines > 1")
    asking = lines.join(shared.select("entity", "bank_index"), ["entity", "bank_index"], "left_semi")
    wanted = settled.join(shared.select("entity", "settlement_id"), ["entity", "settlement_id"], "left_semi")
    return alone.unionByName(greedy_matches(shared, conflict_components(asking, wanted)))


def erp_gap_candidates(without: DataFrame, orphans: DataFrame, basis_points: int = 200, days: int = 3) -> DataFrame:
    """Payments and orphan orders whose amounts and dates are close: never accepted, each with its reason.

    Each pair says how far apart amounts and days are and how alike the order ids, null where either has none.
    Amounts meet in bands of their logarithm and dates in bands of days, each with its neighbours, so the
    join is on equal keys; the exact bounds follow.
    """
    import math

    width = -math.log1p(-min(basis_points, 9_999) / 10_000) * 1.001
    amount = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / width)
    day = lambda c: F.floor(c / (days + 1))
    near = lambda c: F.explode(F.array(c - 1, c, c + 1))
    a = without.withColumn("__a", near(amount(F.col("amount")))).withColumn("__d", near(day(F.col("day")))).alias("a")
    b = orphans.withColumns({"__a": amount(F.col("amount")), "__d": day(F.col("invoice_day"))}).alias("b")
    gap = F.abs(F.col("a.amount") - F.col("b.amount"))
    both = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.__a") == F.col("b.__a")) & (F.col("a.__d") == F.col("b.__d")))
    both = both.where((gap <= F.call_function("div", F.col("a.amount") * basis_points, F.lit(10_000))) & (F.abs(F.col("a.day") - F.col("b.invoice_day")) <= days))
    days_apart = F.abs(F.col("a.day") - F.col("b.invoice_day"))
    alike = text.similarities("ratio")(F.col("a.order_id"), F.col("b.order_id"))
    return both.select("a.entity", "a.row_id", "b.order_id", gap.alias("amount_gap"), days_apart.alias("day_gap"), alike.alias("similarity"), F.lit("no shared identifier").alias("reason"))


def netted_out(rows: DataFrame, by_date: bool = False) -> DataFrame:
    """Payments whose refunds, all made before the payment could settle, add up to it."""
    from ..functions import calendar

    refunds = rows.where("type = 'refund'").groupBy("entity", F.col("payment_id").alias("row_id")).agg(
        F.sum("amount" if by_date else "debit").alias("refunded"), F.max("created_at").alias("last_refund"), F.count(F.lit(1)).alias("n_refunds"))
    both = rows.where("type = 'payment'").join(refunds, ["entity", "row_id"])
    if by_date:
        both = both.where("fee IS NOT NULL")
        early = calendar.local_day(F.col("last_refund")) <= calendar.two_working_days(calendar.local_day(F.col("created_at")))
    else:
        early = F.col("last_refund") <= calendar.eligible_at(F.col("created_at"))
    return both.where((F.col("refunded") == F.col("amount")) & early).select("entity", "row_id", "refunded", "n_refunds")


def reversals(lines: DataFrame, days: int = 7) -> DataFrame:
    """Debit lines paired one to one with the earliest open credit of the same amount that isn't older than ``days``.

    The pairing is greedy in order of date, so an entity's lines of one absolute amount are a queue, which streams
    through a task in order: its state is the open credits of the last ``days`` days, oldest first.
    """
    from collections import deque

    import pyarrow as pa

    names = ["entity", "credit_index", "debit_index", "days"]

    def run(batches):
        at, open_ = None, deque()
        for batch in batches:
            out = []
            for entity, size, day, index, amount in zip(*(batch[c].to_pylist() for c in ("entity", "size", "value_day", "bank_index", "amount")), strict=True):
                if (entity, size) != at:
                    at, open_ = (entity, size), deque()
                while open_ and day - open_[0][0] > days:
                    open_.popleft()
                if amount > 0:
                    open_.append((day, index))
                elif open_:
                    made, credit = open_.popleft()
                    out.append((entity, credit, index, day - made))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    queue = lines.where("amount <> 0").select("entity", F.abs("amount").alias("size"), "value_day", "bank_index", "amount")
    ordered = queue.repartition("entity", "size").sortWithinPartitions("entity", "size", "value_day", "bank_index", "amount")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def run_difference(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of two runs as added, removed, changed or unchanged."""
    b = before.select(*key, F.col(value).alias("before"))
    a = after.select(*key, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return b.join(a, key, "full").withColumn("change", change)
