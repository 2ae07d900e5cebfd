"""What becomes of rows that no bank line explains: proven reasons, open breaks, aging and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from . import joins

#: Who owns a break and what closes it.
ROUTING = [
    ("missing_source", "data ops", "the missing artefact arrives"),
    ("timing_difference", "none -- carry forward", "the item settles in a later window"),
    ("mapping_issue", "integrations", "a linkage is established"),
    ("unexpected_change", "disputes ops", "the hold or reversal resolves"),
    ("true_error", "finance", "the correcting entry posts"),
    ("upstream_unresolved", "whoever owns the causing finding", "the causing bank line becomes Verified or ProvenUnmatched"),
    ("unexplained", "investigation", "-- no close condition is known, which is the point"),
]
#: What a break of a reason asks for at an age; other reasons ask for nothing.
ESCALATION = [
    ("upstream_unresolved", "0-30", "notify"), ("upstream_unresolved", "31-60", "notify"), ("upstream_unresolved", "61-90", "escalate"), ("upstream_unresolved", "90+", "escalate"),
    ("unexplained", "0-30", "notify"), ("unexplained", "31-60", "escalate"), ("unexplained", "61-90", "escalate"), ("unexplained", "90+", "escalate"),
]


def unassigned(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    done = outcomes.where("kind = 'verified'").select("entity", "settlement_id")
    return rows.join(done, ["entity", "settlement_id"], "left_anti")


def proven(rows: DataFrame) -> DataFrame:
    """entity, row_id, proven: payments never captured, payments netted out by refunds, and those refunds."""
    return with_proven(rows, rows).select("entity", "row_id", "proven")


def with_proven(some: DataFrame, rows: DataFrame) -> DataFrame:
    """Some of the rows with what is ``proven`` of each by all of them."""
    netted = joins.netted_out(rows).select("entity", F.col("row_id").alias("payment"), F.lit(True).alias("netted"))
    key = F.when(F.col("type") == "payment", F.col("row_id")).otherwise(F.col("payment_id"))
    reason = F.when((F.col("type") == "payment") & (F.col("credit") == 0), "NOT_CAPTURED").when(F.col("netted"), "NETTED_OUT")
    return some.withColumn("payment", key).join(netted, ["entity", "payment"], "left").withColumn("proven", reason).drop("payment", "netted")


def dispositions(rows: DataFrame, lines: DataFrame, outcomes: DataFrame, causes: DataFrame, disputes: DataFrame) -> DataFrame:
    """One row per unassigned row: proven reason, or open break with reason, cause, age and bucket.

    ``provable``: not eligible by the last statement day, so no credit of this window can hold the row.
    """
    horizon = lines.groupBy("entity").agg(F.max("value_day").alias("horizon"))
    known = disputes.select("entity", "dispute_id", F.lit(True).alias("disputed")).distinct()
    x = with_proven(unassigned(rows, outcomes), rows).join(causes, ["entity", "row_id"], "left").join(horizon, "entity").join(known, ["entity", "dispute_id"], "left")
    payment = F.col("type") == "payment"
    day = calendar.local_day(F.col("created_at"))
    since = F.when(payment, calendar.two_working_days(day)).otherwise(day)
    reason = (
        F.when(F.col("caused_by").isNotNull(), "upstream_unresolved")
        .when(payment & (since > F.col("horizon")), "timing_difference")
        .when(payment & (F.coalesce("disputed", F.lit(False)) | F.col("on_hold")), "unexpected_change")
        .otherwise("unexplained"))
    age = F.greatest(F.lit(0).cast("long"), F.col("horizon") - since)
    open_ = F.col("proven").isNull()
    return x.select(
        "entity", "row_id", "proven", F.when(open_, reason).alias("reason"), F.when(open_, F.col("caused_by")).alias("caused_by"), F.when(open_, reason == "timing_difference").alias("provable"),
        F.when(open_, age).alias("age_days"), F.when(open_, since).alias("first_seen"), F.when(open_, calendar.age_bucket(age)).alias("bucket"), (F.col("credit") - F.col("debit")).alias("net"))


def breaks(found: DataFrame) -> DataFrame:
    """Open breaks as they are reported: rows that share reason, cause, provability and age are one break."""
    return found.where("reason IS NOT NULL").groupBy("entity", "reason", "caused_by", "provable", "age_days", "first_seen").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("net").alias("net"), F.min("row_id").alias("first_row"))


def grouped(found: DataFrame) -> DataFrame:
    """Open breaks by entity, reason and bucket."""
    return found.where("reason IS NOT NULL").groupBy("entity", "reason", "bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("net").alias("net"), F.max("age_days").alias("oldest"))


def routed(groups: DataFrame) -> DataFrame:
    """Breaks with owner, closing condition and what their age asks for."""
    spark = groups.sparkSession
    owners = spark.createDataFrame(ROUTING, "reason string, owner string, closes_when string")
    asks = spark.createDataFrame(ESCALATION, "reason string, bucket string, action string")
    return groups.join(F.broadcast(owners), "reason", "left").join(F.broadcast(asks), ["reason", "bucket"], "left").withColumn("action", F.coalesce("action", F.lit("none")))
