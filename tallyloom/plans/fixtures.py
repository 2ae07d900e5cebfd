"""The reconciliation tables that the benchmark's orders stand for.

Each customer is an entity with its own books; an order is a payment, some orders are refunded, a
customer's year is a settlement and becomes a bank line, with faults planted by whole-number rules so
that SQL can derive the same rows. ``BASE`` is that SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, money


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    failed = (F.col("o_orderstatus") == "F") & (k % 4 == 0)
    method = F.when(F.col("o_orderpriority") == "1-URGENT", "card").when(F.col("o_orderpriority") == "2-HIGH", "netbanking").when(F.col("o_orderpriority") == "3-MEDIUM", "upi").otherwise("wallet")
    amount = F.round(F.col("o_totalprice") * 100).cast("long")
    day = calendar.day_of(F.col("o_orderdate"))
    # in steps, so that what the fee repeats is worked out once a row
    o = o.withColumns({"amount": amount, "failed": failed, "method": method})
    network, card_type = card_of(k, F.col("method"))
    o = o.withColumns({"network": network, "card_type": card_type})
    o = o.withColumn("bare", money.fee(F.col("amount"), money.rate(F.col("network"), F.col("card_type"))))
    o = o.withColumn("charged", money.gst(F.col("bare")))
    failed = F.col("failed")
    return o.select(
        k.alias("k"), c.alias("entity"), "amount", "failed", "method",
        F.when(~failed, F.col("bare") + F.col("charged")).alias("fee"), F.when(~failed, F.col("charged")).alias("tax"), "network", "card_type",
        (day * 86_400 + k % 86_400).alias("created_at"), (k % 23 == 0).alias("on_hold"),
        F.when(~failed & (k % 23 != 0) & (k % 11 != 0), F.concat(F.lit("setl_"), c, F.lit("_"), F.year("o_orderdate"))).alias("settlement_id"),
        F.when(k % 31 == 0, F.concat(F.lit("disp_"), k)).alias("dispute_id"),
    )


def card_of(k, method):
    """Network and type of a card payment, by its number."""
    at = lambda names, n: F.when(method == "card", F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int")))
    return at(("Visa", "Mastercard", "RuPay", "Amex", "Diners"), k % 5), at(("credit", "debit"), F.call_function("div", k, F.lit(5)) % 2)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments and refunds: one row each."""
    o = orders(spark, sf_dir)
    # one pass over the orders: a row for the payment and, where there is one, a row for its refund
    o = o.withColumn("back", F.explode(F.when((F.col("k") % 5 == 0) & ~F.col("failed"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    pay, order = F.concat(F.lit("pay_"), "k"), F.concat(F.lit("order_"), "k")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    refunded = F.when(F.col("k") % 10 == 0, F.col("amount")).otherwise(money.div(F.col("amount"), 2))
    either = lambda refund, payment: F.when(F.col("back"), refund).otherwise(payment)
    return o.select(
        "entity", either(F.concat(F.lit("rfnd_"), "k"), pay).alias("row_id"), either(F.lit("refund"), F.lit("payment")).alias("type"), either(pay, none).alias("payment_id"), order.alias("order_id"),
        either(zero, F.when(F.col("failed"), zero).otherwise(F.col("amount") - F.col("fee"))).alias("credit"), either(refunded, zero).alias("debit"),
        either(refunded, F.col("amount")).alias("amount"), either(zero, F.col("fee")).alias("fee"), either(zero, F.col("tax")).alias("tax"), either(F.lit(False), F.col("on_hold")).alias("on_hold"),
        (F.col("created_at") + either(F.col("k") % 6 * 86_400, zero)).alias("created_at"),
        F.when(F.col("settlement_id").isNotNull(), calendar.eligible_at(F.col("created_at"))).alias("settled_at"), "settlement_id", "method", either(none, F.col("dispute_id")).alias("dispute_id"),
    )


def settlements(rows: DataFrame) -> DataFrame:
    """What the processor paid out: net by settlement, with the ordinal that decides the planted faults."""
    year = F.element_at(F.split("settlement_id", "_"), -1).cast("long")
    return (
        rows.where("settlement_id IS NOT NULL").groupBy("entity", "settlement_id")
        .agg(F.sum(money.net(F.col("credit"), F.col("debit"))).alias("net"), F.count(F.lit(1)).alias("n_rows"), F.max("created_at").alias("last_created_at"))
        .withColumn("ord", F.col("entity") * 100 + year - 1990)
    )


def bank(rows: DataFrame) -> DataFrame:
    """Bank lines: bank_index, entity, reference, value_day, amount."""
    return bank_of(settlements(rows))


def bank_of(s: DataFrame) -> DataFrame:
    """Bank lines of settlements: the credit, its reversal and a foreign credit where the ordinal says so."""
    amount = F.col("net") + F.when(F.col("ord") % 13 == 0, 100).otherwise(0)
    reference = F.when(F.col("ord") % 7 == 0, "").otherwise(F.concat(F.lit("utr_"), F.substring("settlement_id", 6, 100)))
    day = money.div(F.col("last_created_at"), 86_400) + 3 + F.col("ord") % 2
    kinds = F.array_compact(F.array(F.lit(0), F.when((F.col("ord") % 17 == 0) & (F.col("net") > 0), 1), F.when(F.col("ord") % 19 == 0, 2)))
    reversal, foreign = F.col("kind") == 1, F.col("kind") == 2
    return s.withColumn("kind", F.explode(kinds)).select(
        (F.col("ord") * 10 + F.col("kind")).alias("bank_index"), "entity", F.when(foreign, F.concat(F.lit("neft_"), "ord")).otherwise(reference).alias("reference"),
        (day + F.when(reversal, 2).when(foreign, 1).otherwise(0)).alias("value_day"), F.when(reversal, -amount).when(foreign, F.abs(amount) + 5_000).otherwise(amount).alias("amount"))


def report(rows: DataFrame) -> DataFrame:
    """The processor's settlement report: settlement_id, entity, reported_reference, reported_amount, file_position."""
    return report_of(settlements(rows))


def report_of(s: DataFrame) -> DataFrame:
    """The report of settlements."""
    s = s.where("ord % 3 <> 0")
    reference = F.when(F.col("ord") % 7 == 0, F.concat(F.lit("utr_lost_"), "ord")).otherwise(F.concat(F.lit("utr_"), F.substring("settlement_id", 6, 100)))
    return s.select("settlement_id", "entity", reference.alias("reported_reference"), (F.col("net") + F.when(F.col("ord") % 29 == 0, 1).otherwise(0)).alias("reported_amount"), F.col("ord").alias("file_position"))


def erp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order book: a twelfth of the invoices is missing, a fiftieth are orphans."""
    day, orphan = money.div(F.col("created_at"), 86_400), F.col("orphan")
    o = orders(spark, sf_dir).withColumn("orphan", F.explode(F.array_compact(F.array(F.when(F.col("k") % 12 != 0, False), F.when(F.col("k") % 50 == 0, True)))))
    named = lambda own, other: F.concat(F.when(orphan, other).otherwise(own), "k")
    return o.select(
        "entity", named("order_", "orphan_").alias("order_id"), named("INV", "INVX").alias("invoice_no"),
        (F.col("amount") + F.when(orphan, 150).otherwise(0)).alias("amount"), (day + F.when(orphan, 1).otherwise(0)).alias("invoice_day"))


def answer_key(rows: DataFrame) -> DataFrame:
    """What each bank line is and what was planted on it: entity, bank_index, line_kind, planted, settlement_id."""
    return answer_key_of(settlements(rows))


def answer_key_of(s: DataFrame) -> DataFrame:
    """The answer key of settlements."""
    none = F.lit(None).cast("string")
    reversed_ = (F.col("ord") % 17 == 0) & (F.col("net") > 0)
    planted = F.when(reversed_, "reversal").when(F.col("ord") % 13 == 0, "bank_amount").when((F.col("ord") % 29 == 0) & (F.col("ord") % 3 != 0), "report_amount").otherwise("none")
    line = lambda df, at, kind, what, own: df.select("entity", (F.col("ord") * 10 + at).alias("bank_index"), F.lit(kind).alias("line_kind"), what.alias("planted"), own.alias("settlement_id"))
    return (
        line(s, 0, "settlement", planted, F.col("settlement_id")).unionByName(line(s.where(reversed_), 1, "reversal_debit", F.lit("reversal"), none))
        .unionByName(line(s.where("ord % 19 = 0"), 2, "foreign_credit", F.lit("foreign"), none)))


def with_notes(rows: DataFrame) -> DataFrame:
    """Rows with ``notes`` as the feed writes them: an object, an empty list or nothing."""
    k = F.element_at(F.split("row_id", "_"), -1).cast("long")
    order = F.concat(F.lit('{"order": "o'), k % 7, F.lit('"'))
    text = F.when(k % 5 == 0, "{}").when(k % 5 == 1, "[]").when(k % 5 == 2, F.concat(order, F.lit("}"))).when(k % 5 == 3, F.concat(order, F.lit(', "desk": "7"}')))
    return rows.withColumn("notes", text)


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispute file: three quarters of the disputes that payments name; some are lost."""
    o = orders(spark, sf_dir).where("dispute_id IS NOT NULL AND k % 4 <> 0")
    lost = F.col("k") % 62 == 0
    return o.select(
        "entity", "dispute_id", F.when(F.col("k") % 2 == 0, "chargeback").otherwise("retrieval").alias("phase"), F.when(lost, "lost").otherwise("open").alias("status"),
        (F.col("created_at") + 2 * 86_400).alias("opened_at"), F.when(lost, F.col("amount")).otherwise(0).cast("long").alias("amount_deducted"))


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of lost disputes: a debit with neither payment, order nor method."""
    o = orders(spark, sf_dir).where("k % 62 = 0 AND k % 4 <> 0")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return o.select(
        "entity", F.concat(F.lit("adj_"), "k").alias("row_id"), F.lit("adjustment").alias("type"), none.alias("payment_id"), none.alias("order_id"), zero.alias("credit"), F.col("amount").alias("debit"), "amount",
        zero.alias("fee"), zero.alias("tax"), F.lit(False).alias("on_hold"), (F.col("created_at") + 5 * 86_400).alias("created_at"), F.lit(None).cast("long").alias("settled_at"), "settlement_id", none.alias("method"), "dispute_id")


def contested(rows: DataFrame) -> DataFrame:
    """Rows that two candidates of a line dispute: those of settlements with a blank reference and an odd third ordinal."""
    return rows.where("settlement_id IS NOT NULL").join(contested_settlements(settlements(rows)), ["entity", "settlement_id"]).select("entity", "row_id", "bank_index", "n_candidates")


def contested_settlements(s: DataFrame) -> DataFrame:
    return s.where("ord % 7 = 0 AND ord % 3 = 1").select("entity", "settlement_id", (F.col("ord") * 10).alias("bank_index"), F.lit(2).alias("n_candidates"))


def gst_invoices(rows: DataFrame) -> DataFrame:
    """The tax authority's monthly invoices, some of them missing, unsigned or not filed, and those of another supplier."""
    from ..operators.tax import accrued_fees

    return invoices_of(accrued_fees(rows))


def invoices_of(accrued: DataFrame) -> DataFrame:
    """The invoices that stand for each month's accrued fees, of either supplier."""
    n, other = F.regexp_replace("month", "-", "").cast("long") + F.col("entity"), F.col("other")
    a = accrued.withColumn("n", n).withColumn("other", F.explode(F.array_compact(F.array(F.when(F.col("n") % 3 == 1, True), F.when(F.col("n") % 4 != 0, False)))))
    either = lambda theirs, own: F.when(other, theirs).otherwise(own)
    n = F.col("n")
    return a.select(
        "entity", either("27BBBBB0000B1Z3", "29AAAAA0000A1Z5").alias("gstin"), F.concat(either("OTH", "GST"), "entity", F.lit("/"), "month").alias("invoice_no"), F.col("month").alias("filing_period"),
        (F.col("fees") + either(500_000 + n % 7, n % 3 - 1)).alias("taxable_value"), (F.col("taxes") + either(90_000, 0)).alias("tax_total"), either(n % 2 == 0, n % 5 != 0).alias("has_irn"), either(n % 5 != 1, n % 6 != 0).alias("filed"))


BASE = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS entity, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         (o_orderstatus = 'F' AND o_orderkey % 4 = 0) AS failed, year(o_orderdate) AS y,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'netbanking' WHEN '3-MEDIUM' THEN 'upi' ELSE 'wallet' END AS method,
         CASE WHEN o_orderpriority = '1-URGENT' THEN ['Visa', 'Mastercard', 'RuPay', 'Amex', 'Diners'][o_orderkey % 5 + 1] END AS network,
         CASE WHEN o_orderpriority = '1-URGENT' THEN ['credit', 'debit'][o_orderkey // 5 % 2 + 1] END AS card_type,
         CASE WHEN network = 'Amex' OR (network = 'Diners' AND card_type = 'credit') THEN 300 WHEN network = 'RuPay' AND card_type = 'debit' THEN 0 ELSE 200 END AS bp,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day
  FROM orders
), f AS (
  SELECT *, (amount * bp + 9999) // 10000 AS all_fee, day * 86400 + k % 86400 AS created_at,
         CASE WHEN NOT failed AND k % 23 <> 0 AND k % 11 <> 0 THEN 'setl_' || entity || '_' || y END AS settlement_id
  FROM o
), e AS (
  SELECT *, CASE WHEN NOT failed THEN all_fee + (all_fee * 18 + 99) // 100 END AS fee, CASE WHEN NOT failed THEN (all_fee * 18 + 99) // 100 END AS tax,
         (created_at + 19800) // 86400 AS lday FROM f
), g AS (
  SELECT *, CASE WHEN settlement_id IS NOT NULL THEN (lday + CASE WHEN (lday + 4) % 7 IN (4, 5) THEN 4 WHEN (lday + 4) % 7 = 6 THEN 3 ELSE 2 END) * 86400 + 39600 - 19800 END AS settled_at FROM e
), ledger AS (
  SELECT entity, 'pay_' || k AS row_id, 'payment' AS type, CAST(NULL AS VARCHAR) AS payment_id, 'order_' || k AS order_id,
         CASE WHEN failed THEN 0 ELSE amount - fee END AS credit, CAST(0 AS BIGINT) AS debit, amount, fee, tax, k % 23 = 0 AS on_hold,
         created_at, settled_at, settlement_id, method, CASE WHEN k % 31 = 0 THEN 'disp_' || k END AS dispute_id
  FROM g
  UNION ALL
  SELECT entity, 'rfnd_' || k, 'refund', 'pay_' || k, 'order_' || k, 0, CASE WHEN k % 10 = 0 THEN amount ELSE amount // 2 END,
         CASE WHEN k % 10 = 0 THEN amount ELSE amount // 2 END, 0, 0, FALSE, created_at + k % 6 * 86400, settled_at, settlement_id, method, NULL
  FROM g WHERE k % 5 = 0 AND NOT failed
), settlements AS (
  SELECT entity, settlement_id, CAST(sum(credit - debit) AS BIGINT) AS net, count(*) AS n_rows, max(created_at) AS last_created_at,
         entity * 100 + CAST(string_split(settlement_id, '_')[3] AS BIGINT) - 1990 AS ord
  FROM ledger WHERE settlement_id IS NOT NULL GROUP BY entity, settlement_id
), sb AS (
  SELECT *, net + CASE WHEN ord % 13 = 0 THEN 100 ELSE 0 END AS bank_amount, last_created_at // 86400 + 3 + ord % 2 AS value_day,
         CASE WHEN ord % 7 = 0 THEN '' ELSE 'utr_' || substr(settlement_id, 6) END AS reference FROM settlements
), bank AS (
  SELECT ord * 10 AS bank_index, entity, reference, value_day, bank_amount AS amount FROM sb
  UNION ALL SELECT ord * 10 + 1, entity, reference, value_day + 2, -bank_amount FROM sb WHERE ord % 17 = 0 AND net > 0
  UNION ALL SELECT ord * 10 + 2, entity, 'neft_' || ord, value_day + 1, abs(bank_amount) + 5000 FROM sb WHERE ord % 19 = 0
), report AS (
  SELECT settlement_id, entity, CASE WHEN ord % 7 = 0 THEN 'utr_lost_' || ord ELSE 'utr_' || substr(settlement_id, 6) END AS reported_reference,
         net + CASE WHEN ord % 29 = 0 THEN 1 ELSE 0 END AS reported_amount, ord AS file_position
  FROM settlements WHERE ord % 3 <> 0
), erp AS (
  SELECT entity, 'order_' || k AS order_id, 'INV' || k AS invoice_no, amount, created_at // 86400 AS invoice_day FROM g WHERE k % 12 <> 0
  UNION ALL SELECT entity, 'orphan_' || k, 'INVX' || k, amount + 150, created_at // 86400 + 1 FROM g WHERE k % 50 = 0
), accrued AS (
  SELECT entity, strftime(DATE '1970-01-01' + CAST((settled_at + 19800) // 86400 AS INTEGER), '%Y-%m') AS month,
         CAST(sum(CASE WHEN coalesce(tax, 0) <> 0 THEN fee - tax ELSE 0 END) AS BIGINT) AS fees,
         CAST(sum(CASE WHEN coalesce(tax, 0) <> 0 THEN tax ELSE 0 END) AS BIGINT) AS taxes,
         CAST(sum(CASE WHEN coalesce(tax, 0) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows
  FROM ledger WHERE type = 'payment' AND settled_at IS NOT NULL AND coalesce(fee, 0) <> 0 GROUP BY 1, 2
), gn AS (
  SELECT *, CAST(replace(month, '-', '') AS BIGINT) + entity AS n FROM accrued
), gst_every AS (
  SELECT entity, '29AAAAA0000A1Z5' AS gstin, 'GST' || entity || '/' || month AS invoice_no, month AS filing_period, fees + n % 3 - 1 AS taxable_value,
         taxes AS tax_total, n % 5 <> 0 AS has_irn, n % 6 <> 0 AS filed FROM gn WHERE n % 4 <> 0
  UNION ALL SELECT entity, '27BBBBB0000B1Z3', 'OTH' || entity || '/' || month, month, fees + 500000 + n % 7, taxes + 90000, n % 2 = 0, n % 5 <> 1 FROM gn WHERE n % 3 = 1
), suppliers AS (
  SELECT entity, gstin FROM (SELECT a.entity, g.gstin, row_number() OVER (PARTITION BY a.entity ORDER BY count(*) DESC, g.gstin) AS place
    FROM accrued a JOIN gst_every g ON g.entity = a.entity AND abs(g.taxable_value - a.fees) <= greatest(1, a.n_rows) GROUP BY a.entity, g.gstin) WHERE place = 1
), gst AS (
  SELECT g.* FROM gst_every g JOIN suppliers s ON s.entity = g.entity AND s.gstin = g.gstin
), disputes AS (
  SELECT entity, 'disp_' || k AS dispute_id, CASE WHEN k % 2 = 0 THEN 'chargeback' ELSE 'retrieval' END AS phase, CASE WHEN k % 62 = 0 THEN 'lost' ELSE 'open' END AS status,
         created_at + 2 * 86400 AS opened_at, CASE WHEN k % 62 = 0 THEN amount ELSE 0 END AS amount_deducted FROM f WHERE k % 31 = 0 AND k % 4 <> 0
), every_row AS (
  SELECT * FROM ledger UNION ALL
  SELECT entity, 'adj_' || k, 'adjustment', NULL, NULL, 0, amount, amount, 0, 0, FALSE, created_at + 5 * 86400, NULL, settlement_id, NULL, 'disp_' || k FROM f WHERE k % 62 = 0 AND k % 4 <> 0
), contested AS (
  SELECT l.entity, l.row_id, s.ord * 10 AS bank_index, 2 AS n_candidates FROM ledger l JOIN settlements s ON s.settlement_id = l.settlement_id WHERE s.ord % 7 = 0 AND s.ord % 3 = 1
), answer AS (
  SELECT entity, ord * 10 AS bank_index, 'settlement' AS line_kind, CASE WHEN ord % 17 = 0 AND net > 0 THEN 'reversal' WHEN ord % 13 = 0 THEN 'bank_amount' WHEN ord % 29 = 0 AND ord % 3 <> 0 THEN 'report_amount' ELSE 'none' END AS planted, settlement_id FROM settlements
  UNION ALL SELECT entity, ord * 10 + 1, 'reversal_debit', 'reversal', NULL FROM settlements WHERE ord % 17 = 0 AND net > 0
  UNION ALL SELECT entity, ord * 10 + 2, 'foreign_credit', 'foreign', NULL FROM settlements WHERE ord % 19 = 0
), noted AS (
  SELECT *, CASE CAST(string_split(row_id, '_')[2] AS BIGINT) % 5 WHEN 0 THEN '{}' WHEN 1 THEN '[]' WHEN 2 THEN '{"order": "o' || CAST(string_split(row_id, '_')[2] AS BIGINT) % 7 || '"}'
    WHEN 3 THEN '{"order": "o' || CAST(string_split(row_id, '_')[2] AS BIGINT) % 7 || '", "desk": "7"}' END AS notes FROM ledger
)
"""
