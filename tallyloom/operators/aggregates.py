"""Grouped figures over ledger, bank and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, money


def batches(rows: DataFrame, one_moment: bool = False) -> DataFrame:
    """Settlements with sums and their sorted rows; two references within one settlement raise, as do two moments if it must have one."""
    rows = single_valued(rows, ["entity", "settlement_id"], "settled_at") if one_moment else rows
    own = rows.where("settlement_id IS NOT NULL AND (type <> 'payment' OR fee IS NOT NULL)")
    months = F.count_distinct(calendar.month_of(calendar.local_day(F.col("settled_at"))))
    reference = F.col("settlement_utr") if "settlement_utr" in rows.columns else F.lit(None).cast("string")
    two = F.raise_error(F.concat(F.lit("two references in "), "settlement_id"))
    return own.groupBy("entity", "settlement_id").agg(
        F.sum("credit").alias("credit"), F.sum("debit").alias("debit"), F.array_sort(F.collect_list("row_id")).alias("row_ids"), months.alias("n_months"),
        F.min(reference).alias("low"), F.max(reference).alias("high")).withColumn("reference", F.when(F.col("low") != F.col("high"), two).otherwise(F.col("low"))).drop("low", "high")


def single_valued(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``df``; a group with two values of ``column`` raises, but for rows without the last key."""
    w = Window.partitionBy(*keys)
    named = F.col(keys[-1]).isNotNull()
    odd = named & (F.min(column).over(w) != F.max(column).over(w))
    check = F.when(odd, F.raise_error(F.concat(F.lit(f"two values of {column} in "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))))
    return df.withColumn("__check", check).where("__check IS NULL").drop("__check")


def naive_matches(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The baseline: group by settlement and take the bank line of that amount if amount and line are unique."""
    nets = rows.where("settlement_id IS NOT NULL").groupBy("entity", "settlement_id").agg(F.sum(money.net(F.col("credit"), F.col("debit"))).alias("net"))
    one_net = nets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity", "net"))).where("n = 1").drop("n")
    one_line = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity", "amount"))).where("n = 1").select("entity", "bank_index", F.col("amount").alias("net"))
    return one_net.join(one_line, ["entity", "net"]).select("entity", "settlement_id", "bank_index", "net")


def lag_buckets(rows: DataFrame) -> DataFrame:
    """Days from creation to settlement in five half-open buckets; empty ones are kept."""
    spark = rows.sparkSession
    names = spark.createDataFrame([("0-1",), ("1-2",), ("2-3",), ("3-5",), ("5+",)], "bucket string")
    lag = money.div(F.col("settled_at") - F.col("created_at"), 86_400)
    bucket = F.when(lag < 1, "0-1").when(lag < 2, "1-2").when(lag < 3, "2-3").when(lag < 5, "3-5").otherwise("5+")
    found = rows.where("settled_at >= created_at").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(lag).alias("longest"))
    return F.broadcast(names).join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "longest")


def unsettled_aging(rows: DataFrame) -> DataFrame:
    """Value and count of unsettled payments by age at the data's own last moment."""
    last = rows.agg(F.greatest(F.max("created_at"), F.max("settled_at")).alias("as_of"))
    age = money.div(F.col("as_of") - F.col("created_at"), 86_400)
    open_ = rows.where("type = 'payment' AND settled_at IS NULL").crossJoin(F.broadcast(last))  # one row
    return open_.groupBy(calendar.age_bucket(age).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value"))


def method_breakdown(rows: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Payments by method: count, value, open breaks among them, break rate in basis points, and counts by card network, most first."""
    paid = rows.where("method IS NOT NULL AND type = 'payment'").join(open_rows.select("entity", "row_id", F.lit(1).alias("open")).distinct(), ["entity", "row_id"], "left")
    total = paid.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value"), F.count("open").alias("breaks"))
    nested = paid.where("network IS NOT NULL").groupBy("method", "network").count()
    nested = nested.groupBy("method").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "network"))).alias("x"))
    shown = F.array_join(F.transform("x", lambda s: F.concat(s["network"], F.lit("="), -s["c"])), ",")
    return total.join(nested.select("method", shown.alias("networks")), "method", "left").withColumns(
        {"networks": F.coalesce("networks", F.lit("")), "break_rate_bp": F.call_function("div", F.col("breaks") * 10_000, F.col("n"))})


def claimed_rows(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The rows of settlements that verified or reconstructed lines name, each once."""
    named = outcomes.where(F.col("kind").isin("verified", "reconstructed") & F.col("settlement_id").isNotNull()).select("entity", "settlement_id").distinct()
    return rows.join(named, ["entity", "settlement_id"], "left_semi").dropDuplicates(["entity", "row_id"])


def journal(rows: DataFrame) -> DataFrame:
    """Four lines of the rows that bank lines are known to hold: what discharged the processor's receivable.

    Cash, fees (tax included, so a payment's credit is its amount less its fee) and refunds are debits, the cleared
    gross is the credit. A row with a debit, refund or adjustment, counts as refund.
    """
    plain = F.coalesce("debit", F.lit(0)) == 0
    total = lambda c, when: F.sum(F.when(when, F.coalesce(c, F.lit(0))).otherwise(0)).cast("long")
    t = rows.groupBy("entity").agg(total("amount", plain).alias("gross"), total("debit", ~plain).alias("refunds"), total("fee", plain).alias("fees"))
    zero = F.lit(0).cast("long")
    line = lambda n, account, debit, credit: F.struct(F.lit(n).alias("line"), F.lit(account).alias("account"), debit.alias("debit"), credit.alias("credit"))
    return t.select("entity", F.inline(F.array(
        line(1, "Bank", F.col("gross") - F.col("fees") - F.col("refunds"), zero), line(2, "Processing Fees", F.col("fees"), zero),
        line(3, "Refund Liability", F.col("refunds"), zero), line(4, "PSP Clearing", zero, F.col("gross")))))


def journal_checks(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Per entity: debits equal credits, and the bank line ties to the sum of the rows' credits less debits."""
    nets = rows.groupBy("entity").agg(F.sum(F.col("credit") - F.col("debit")).alias("net"))
    t = lines.groupBy("entity").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.max(F.when(F.col("line") == 1, F.col("debit"))).alias("bank"))
    return t.join(nets, "entity").select("entity", (F.col("d") == F.col("c")).alias("balanced"), (F.col("bank") == F.col("net")).alias("tied"))


def period(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """First and last day over ledger and bank."""
    days = rows.select("entity", money.div(F.col("created_at"), 86_400).alias("day")).unionByName(
        rows.where("settled_at IS NOT NULL").select("entity", money.div(F.col("settled_at"), 86_400).alias("day"))).unionByName(lines.select("entity", F.col("value_day").alias("day")))
    return days.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def cross_month(rows: DataFrame) -> DataFrame:
    """Rows that settle in another month than they were made in, and days with several settlements."""
    made, settled = calendar.month_of(calendar.local_day(F.col("created_at"))), calendar.month_of(calendar.local_day(F.col("settled_at")))
    moved = rows.where(F.col("settled_at").isNotNull() & (made != settled)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_moved"))
    days = rows.where("settlement_id IS NOT NULL").groupBy("entity", calendar.local_day(F.col("settled_at")).alias("d")).agg(F.count_distinct("settlement_id").alias("s"))
    split = days.where("s > 1").groupBy("entity").agg(F.count(F.lit(1)).alias("n_split_days"))
    return moved.join(split, "entity", "full").na.fill(0, ["n_moved", "n_split_days"])


def fee_identity(rows: DataFrame) -> DataFrame:
    """Which of two identities the credits obey; indecisive where both hold for every row."""
    paid = rows.where("type = 'payment' AND fee IS NOT NULL")
    a, b = F.col("credit") == F.col("amount") - F.col("fee"), F.col("credit") == F.col("amount") - F.col("fee") - F.col("tax")
    t = paid.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("fee_includes_tax"), F.count_if(b).alias("tax_on_top"))
    full = lambda c: F.col(c) == F.col("n")
    verdict = F.when(full("fee_includes_tax") & full("tax_on_top"), "indecisive").when(full("tax_on_top"), "tax_on_top").when(full("fee_includes_tax"), "fee_includes_tax").otherwise("neither")
    return t.withColumn("verdict", verdict)


def field_census(df: DataFrame) -> DataFrame:
    """column, n_rows, n_non_null of every column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(c) for c in df.columns))
    return one.select(F.col("__n").alias("n_rows"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_non_null")) for c in df.columns))))


def outcome_accounting(outcomes: DataFrame) -> DataFrame:
    """Counts and value by kind and reason."""
    return outcomes.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.abs("amount")).alias("value"))


def full_accounting(outcomes: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Everything that a run is held to, as (measure, item, n): lines by kind and reason, rows by reason and age, causes, candidates.

    A line with one answer counts as one candidate, an ambiguous one as many as it has; declined lines have none.
    Reasons of rows count rows, reasons of lines count lines.
    """
    of = lambda df, measure, item: df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), "item", "n")
    open_ = dispositions.where("reason IS NOT NULL")
    size = F.when(F.col("kind").isin("verified", "reconstructed"), 1).when(F.col("kind") == "ambiguous", F.col("n_candidates"))
    sized = outcomes.agg(F.count(size).alias("lines"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("most"))
    causes = open_.agg(F.count_distinct("caused_by").alias("distinct"), F.count("caused_by").alias("clustered_rows"))
    spread = lambda df, measure: df.select(F.lit(measure).alias("measure"), F.inline(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in df.columns))))
    return reduce(DataFrame.unionByName, [
        of(outcomes, "line kind", F.col("kind")), of(outcomes.where("reason IS NOT NULL"), "line reason", F.concat_ws("/", "kind", "reason")),
        of(dispositions.where("proven IS NOT NULL"), "proven row", F.col("proven")), of(open_, "open row", F.col("reason")), of(open_, "open row by age", F.col("bucket")),
        spread(causes, "causes"), spread(sized, "candidates")])


def rival_accounting(rivals: DataFrame) -> DataFrame:
    """Verified lines, those that other sets would explain as well, and those whose rivals weren't all counted."""
    return rivals.agg(F.count(F.lit(1)).alias("verified"), F.count_if(F.expr("rivals > 1 OR lower_bound")).alias("not_decisive"), F.count_if("lower_bound").alias("truncated"), F.max("rivals").alias("most_rivals"))


def kpis(outcomes: DataFrame) -> DataFrame:
    """Shares of each entity's credit lines in basis points, and its unreconciled value.

    Straight through: answered without a human; first pass: on an identifier alone; on attested: answered,
    of the lines that the processor attests to (none if it attests to none).
    """
    bp = lambda c: F.call_function("div", F.count_if(c) * 10_000, F.count(F.lit(1)))
    done, attested = F.col("kind").isin("verified", "reconstructed"), (F.col("tier") == "A") & F.col("settlement_id").isNotNull()
    n = F.count_if(attested)
    return outcomes.where("amount > 0").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_lines"), bp(done).alias("straight_through_bp"), bp(F.col("kind") == "verified").alias("first_pass_bp"), bp(F.col("kind") == "discrepancy").alias("exception_bp"),
        n.alias("attested"), F.when(n > 0, F.call_function("div", F.count_if(attested & done) * 10_000, F.greatest(n, F.lit(1)))).alias("on_attested_bp"),
        F.sum(F.when(~done, F.col("amount")).otherwise(0)).alias("unreconciled"))
