"""Tax-credit operators: fee accrual by month, credits at risk, the supplier behind the invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .storage import kept


def accrues(fee: str = "fee", tax: str = "tax"):
    """A settled payment with a fee and a tax accrues input tax; zero counts as none."""
    return (F.col("type") == "payment") & F.col("settled_at").isNotNull() & (F.coalesce(fee, F.lit(0)) != 0) & (F.coalesce(tax, F.lit(0)) != 0)


def accrued_fees(rows: DataFrame) -> DataFrame:
    """entity, month, fees, taxes, n_rows: a fee without tax opens its month but adds nothing."""
    settled = rows.where((F.col("type") == "payment") & F.col("settled_at").isNotNull() & (F.coalesce("fee", F.lit(0)) != 0))
    taxed = F.coalesce("tax", F.lit(0)) != 0
    month = calendar.month_of(calendar.local_day(F.col("settled_at")))
    total = lambda c: F.sum(F.when(taxed, c).otherwise(0)).cast("long")
    return settled.groupBy("entity", month.alias("month")).agg(
        total(F.col("fee") - F.col("tax")).alias("fees"), total(F.col("tax")).alias("taxes"), total(F.lit(1)).alias("n_rows"))


def fees_without_tax(rows: DataFrame) -> DataFrame:
    bare = rows.where((F.col("type") == "payment") & (F.coalesce("fee", F.lit(0)) != 0) & (F.coalesce("tax", F.lit(0)) == 0))
    return bare.groupBy("entity").agg(F.sum("fee").alias("fees"), F.count(F.lit(1)).alias("n_rows"))


def months_at_risk(accrued: DataFrame, invoices: DataFrame) -> DataFrame:
    """entity, month, ground: no invoice, no registration number, supplier's return not filed; grounds may meet.

    Only the supplier's own invoices count; where none can be told there are no grounds.
    """
    # only what decides: every column more is dealt and sorted
    absent, own = of_supplier(accrued.select("entity", "month", "fees", "n_rows"), invoices.select("entity", "gstin", "filing_period", "taxable_value", "has_irn", "filed"))
    own = own.withColumnRenamed("filing_period", "month")
    return (
        absent.select("entity", "month", F.lit("gstr2b_absent").alias("ground"))
        .unionByName(own.where("NOT has_irn").select("entity", "month", F.lit("gstr2b_no_irn").alias("ground")))
        .unionByName(own.where("NOT filed").select("entity", "month", F.lit("gstr2b_37a_exposure").alias("ground")))
    )


def of_supplier(accrued: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Months of entities with a known supplier for which it has no invoice, and the supplier's invoices."""
    of = lambda *more: Window.partitionBy("entity", *more)
    both = _together(accrued, invoices).withColumn("hits", F.sum("hits").over(of("gstin")))
    both = both.withColumn("known", F.min(F.when(F.col("hits") > 0, F.struct(-F.col("hits"), "gstin"))).over(of()))
    both = both.where("known IS NOT NULL").withColumn("own", F.coalesce(F.col("invoice").isNotNull() & (F.col("gstin") == F.col("known.gstin")), F.lit(False)))
    absent = F.col("accrued").isNotNull() & (F.col("month").isNull() | ~F.max("own").over(of("month")))
    both = kept(both.withColumn("absent", absent).where("own OR absent").select("accrued", "invoice"), "supplier-invoices")  # read for each ground
    return both.where("accrued IS NOT NULL").select("accrued.*"), both.where("invoice IS NOT NULL").select("invoice.*")


def _together(accrued: DataFrame, invoices: DataFrame) -> DataFrame:
    """entity, month, gstin, accrued, invoice, hits: each month and each invoice is a row, and all of an entity lie together.

    ``hits`` of an invoice are the months whose fees it is within max(1, n_rows) of; an entity has as many months as it has seen.
    """
    a = accrued.select("entity", "month", F.struct(*accrued.columns).alias("accrued"))
    i = invoices.select("entity", F.col("filing_period").alias("month"), "gstin", F.struct(*invoices.columns).alias("invoice"))
    every = a.unionByName(i, allowMissingColumns=True).where("entity IS NOT NULL").repartition("entity").sortWithinPartitions("entity", "gstin")
    fees = F.when(F.col("accrued").isNotNull(), F.struct("accrued.fees", F.greatest(F.lit(1), F.col("accrued.n_rows")).alias("room")))
    every = every.withColumn("months", F.collect_list(fees).over(Window.partitionBy("entity")))
    near = F.filter("months", lambda m: F.abs(F.col("invoice.taxable_value") - m["fees"]) <= m["room"])
    return every.withColumn("hits", F.when(F.col("invoice").isNotNull(), F.size(near))).drop("months")


def at_risk_total(risk: DataFrame, accrued: DataFrame, invoices: DataFrame) -> DataFrame:
    """Tax at risk by ground; an invoice with two grounds counts in each."""
    tax = accrued.select("entity", "month", "taxes").join(
        of_supplier(accrued, invoices)[1].select("entity", F.col("filing_period").alias("month"), "tax_total"), ["entity", "month"], "full")
    return risk.join(tax, ["entity", "month"]).groupBy("ground").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum(F.coalesce("tax_total", "taxes")).alias("tax_at_risk"))


def supplier(accrued: DataFrame, invoices: DataFrame) -> DataFrame:
    """The supplier most of whose invoices are within max(1, n_rows) of a month's fees: entity, gstin, hits."""
    hits = _together(accrued, invoices).where("hits > 0").groupBy("entity", "gstin").agg(F.sum("hits").alias("hits"))
    first = Window.partitionBy("entity").orderBy(F.desc("hits"), "gstin")
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def residuals(accrued: DataFrame, invoices: DataFrame) -> DataFrame:
    """The supplier's invoiced less accrued by month, and whether rounding explains it."""
    both = accrued.join(of_supplier(accrued, invoices)[1].withColumnRenamed("filing_period", "month"), ["entity", "month"])
    gap = F.col("taxable_value") - F.col("fees")
    return both.select("entity", "month", gap.alias("residual"), (F.abs(gap) <= F.greatest(F.lit(1), F.col("n_rows"))).alias("rounding"))


def panel(invoices: DataFrame) -> DataFrame:
    """Counts of a tax filing."""
    return invoices.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_invoices"), F.count_if("has_irn").alias("with_number"), F.count_if("filed").alias("n_filed"), F.count_if(F.expr("has_irn AND filed")).alias("n_available"))
