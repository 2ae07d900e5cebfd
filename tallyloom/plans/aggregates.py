"""Grouped and ordered queries over the derived books and their SQL."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import tax as T
from ..operators import windows as W
from . import fixtures as X
from .fixtures import BASE


def a1_batches(spark, sf):
    rows = X.ledger(spark, sf)
    rows = rows.withColumn("settlement_utr", F.when(F.col("type") != "adjustment", F.concat(F.lit("utr_"), F.substring("settlement_id", 6, 100))))
    return A.batches(rows).select("entity", "settlement_id", "reference", "credit", "debit", F.array_join("row_ids", ",").alias("row_ids"))


def a3_naive_matches(spark, sf):
    rows = X.ledger(spark, sf)
    return A.naive_matches(rows, X.bank(rows))


def a4_accrued_fees(spark, sf):
    return T.accrued_fees(X.ledger(spark, sf))


def a5_fees_without_tax(spark, sf):
    return T.fees_without_tax(X.ledger(spark, sf).withColumn("tax", F.when(F.col("method") == "upi", 0).otherwise(F.col("tax"))))


def a6_tax_at_risk(spark, sf):
    rows = X.ledger(spark, sf)
    a, g = T.accrued_fees(rows), X.gst_invoices(rows)
    return T.at_risk_total(T.months_at_risk(a, g), a, g)


def a15_lag_buckets(spark, sf):
    return A.lag_buckets(X.ledger(spark, sf))


def a16_unsettled_aging(spark, sf):
    return A.unsettled_aging(X.ledger(spark, sf))


def a21_tax_panel(spark, sf):
    return T.panel(X.gst_invoices(X.ledger(spark, sf)))


def a25_period(spark, sf):
    rows = X.ledger(spark, sf)
    return A.period(rows, X.bank(rows))


def a26_cross_month(spark, sf):
    return A.cross_month(X.ledger(spark, sf))


def a27_fee_identity(spark, sf):
    return A.fee_identity(X.ledger(spark, sf))


def s15_field_census(spark, sf):
    return A.field_census(X.ledger(spark, sf))


def d7_months_at_risk(spark, sf):
    rows = X.ledger(spark, sf)
    return T.months_at_risk(T.accrued_fees(rows), X.gst_invoices(rows))


def d11_tax_residuals(spark, sf):
    rows = X.ledger(spark, sf)
    return T.residuals(T.accrued_fees(rows), X.gst_invoices(rows))


def j12_supplier(spark, sf):
    rows = X.ledger(spark, sf)
    return T.supplier(T.accrued_fees(rows), X.gst_invoices(rows))


def w1_processing_order(spark, sf):
    return W.processing_order(X.bank(X.ledger(spark, sf))).select("bank_index", "entity", "seq")


def w4_rivals(spark, sf):
    rows = X.ledger(spark, sf)
    lines = X.bank(rows)
    return W.rivals(lines, lines.where("reference <> '' AND amount > 0"))


def w10_separators(spark, sf):
    return W.separators(X.ledger(spark, sf), "amount", "type = 'refund'")


def w11_dense_references(spark, sf):
    rows = X.settlements(X.ledger(spark, sf))
    return W.dense_references(rows.withColumn("year", F.col("ord") % 100), "entity", "year")


def w12_fifo_under_cap(spark, sf):
    return W.fifo_under_cap(X.ledger(spark, sf).where("credit > 0"), "entity", ["created_at", "row_id"], "credit", "row_id", 50_000_000)


def w13_debits_deferred(spark, sf):
    rows = X.ledger(spark, sf)
    return W.debits_deferred(rows.withColumn("debit", F.col("debit") * 3))


def q5_ks_distance(spark, sf):
    return W.ks_distance(X.ledger(spark, sf), "created_at", "type = 'refund'")


def t6_common_levels(spark, sf):
    rows = X.ledger(spark, sf)
    n = rows.groupBy("method", "type").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "method")).cast("long")).where("r <= 40").select("type", "method", "n", "r")


def t8_announced_truncation(spark, sf):
    """Twelve rows of each entity, how many there are, and whether some aren't shown."""
    from pyspark.sql import Window

    rows = X.ledger(spark, sf).select("entity", "row_id")
    n = F.row_number().over(Window.partitionBy("entity").orderBy("row_id"))
    shown = rows.withColumn("n", n).where("n <= 12").groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("sample"))
    return shown.join(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("total")), "entity").withColumn("truncated", F.col("total") > 12)


QUERIES = {f.__name__: f for f in (
    a1_batches, a3_naive_matches, a4_accrued_fees, a5_fees_without_tax, a6_tax_at_risk, a15_lag_buckets, a16_unsettled_aging,
    a21_tax_panel, a25_period, a26_cross_month, a27_fee_identity, s15_field_census, d7_months_at_risk, d11_tax_residuals, j12_supplier,
    w1_processing_order, w4_rivals, w10_separators, w11_dense_references, w12_fifo_under_cap, w13_debits_deferred, q5_ks_distance, t6_common_levels, t8_announced_truncation)}
_RISK = """
, risk AS (SELECT entity, month, 'gstr2b_absent' AS ground FROM accrued a SEMI JOIN suppliers s ON s.entity = a.entity WHERE NOT EXISTS (SELECT 1 FROM gst g WHERE g.entity = a.entity AND g.filing_period = a.month)
UNION ALL SELECT entity, filing_period, 'gstr2b_no_irn' FROM gst WHERE NOT has_irn
UNION ALL SELECT entity, filing_period, 'gstr2b_37a_exposure' FROM gst WHERE NOT filed)"""
_COLUMNS = ["entity", "row_id", "type", "payment_id", "order_id", "credit", "debit", "amount", "fee", "tax", "on_hold", "created_at", "settled_at", "settlement_id", "method", "dispute_id"]
ORACLES = {
    "a1_batches": BASE + """
SELECT entity, settlement_id, 'utr_' || substr(settlement_id, 6) AS reference, CAST(sum(credit) AS BIGINT) AS credit, CAST(sum(debit) AS BIGINT) AS debit, string_agg(row_id, ',' ORDER BY row_id) AS row_ids
FROM ledger WHERE settlement_id IS NOT NULL AND (type <> 'payment' OR fee IS NOT NULL) GROUP BY 1, 2""",
    "a3_naive_matches": BASE + """
, a AS (SELECT *, count(*) OVER (PARTITION BY entity, net) AS n FROM settlements), b AS (SELECT *, count(*) OVER (PARTITION BY entity, amount) AS n FROM bank)
SELECT a.entity, a.settlement_id, b.bank_index, a.net FROM a JOIN b ON a.entity = b.entity AND a.net = b.amount WHERE a.n = 1 AND b.n = 1""",
    "a4_accrued_fees": BASE + "SELECT * FROM accrued",
    "a5_fees_without_tax": BASE + """
SELECT entity, CAST(sum(fee) AS BIGINT) AS fees, count(*) AS n_rows FROM ledger
WHERE type = 'payment' AND coalesce(fee, 0) <> 0 AND (coalesce(tax, 0) = 0 OR method = 'upi') GROUP BY entity""",
    "a6_tax_at_risk": BASE + _RISK + """
SELECT r.ground, count(*) AS n_findings, CAST(sum(coalesce(g.tax_total, a.taxes)) AS BIGINT) AS tax_at_risk
FROM risk r JOIN accrued a USING (entity, month) LEFT JOIN gst g ON g.entity = r.entity AND g.filing_period = r.month GROUP BY 1""",
    "a15_lag_buckets": BASE + """
, l AS (SELECT (settled_at - created_at) // 86400 AS lag FROM ledger WHERE settled_at >= created_at),
b AS (SELECT CASE WHEN lag < 1 THEN '0-1' WHEN lag < 2 THEN '1-2' WHEN lag < 3 THEN '2-3' WHEN lag < 5 THEN '3-5' ELSE '5+' END AS bucket, lag FROM l),
n AS (SELECT unnest(['0-1', '1-2', '2-3', '3-5', '5+']) AS bucket)
SELECT n.bucket, count(b.lag) AS n, max(b.lag) AS longest FROM n LEFT JOIN b USING (bucket) GROUP BY 1""",
    "a16_unsettled_aging": BASE + """
, m AS (SELECT greatest(max(created_at), max(settled_at)) AS as_of FROM ledger), a AS (SELECT amount, (as_of - created_at) // 86400 AS age FROM ledger, m WHERE type = 'payment' AND settled_at IS NULL)
SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '90+' END AS bucket, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value FROM a GROUP BY 1""",
    "a21_tax_panel": BASE + """
SELECT entity, count(*) AS n_invoices, count(CASE WHEN has_irn THEN 1 END) AS with_number, count(CASE WHEN filed THEN 1 END) AS n_filed, count(CASE WHEN has_irn AND filed THEN 1 END) AS n_available FROM gst_every GROUP BY 1""",
    "a25_period": BASE + """
, d AS (SELECT entity, created_at // 86400 AS day FROM ledger UNION ALL SELECT entity, settled_at // 86400 FROM ledger WHERE settled_at IS NOT NULL UNION ALL SELECT entity, value_day FROM bank)
SELECT entity, min(day) AS first_day, max(day) AS last_day FROM d GROUP BY 1""",
    "a26_cross_month": BASE + """
, m AS (SELECT entity, count(*) AS n_moved FROM ledger WHERE settled_at IS NOT NULL
  AND strftime(DATE '1970-01-01' + CAST((settled_at + 19800) // 86400 AS INTEGER), '%Y-%m') <> strftime(DATE '1970-01-01' + CAST((created_at + 19800) // 86400 AS INTEGER), '%Y-%m') GROUP BY 1),
d AS (SELECT entity, (settled_at + 19800) // 86400 AS d, count(DISTINCT settlement_id) AS s FROM ledger WHERE settlement_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT entity, count(*) AS n_split_days FROM d WHERE s > 1 GROUP BY 1)
SELECT coalesce(m.entity, x.entity) AS entity, coalesce(n_moved, 0) AS n_moved, coalesce(n_split_days, 0) AS n_split_days FROM m FULL JOIN x ON m.entity = x.entity""",
    "a27_fee_identity": BASE + """
, t AS (SELECT method, count(*) AS n, count(CASE WHEN credit = amount - fee THEN 1 END) AS fee_includes_tax, count(CASE WHEN credit = amount - fee - tax THEN 1 END) AS tax_on_top
  FROM ledger WHERE type = 'payment' AND fee IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN fee_includes_tax = n AND tax_on_top = n THEN 'indecisive' WHEN tax_on_top = n THEN 'tax_on_top' WHEN fee_includes_tax = n THEN 'fee_includes_tax' ELSE 'neither' END AS verdict FROM t""",
    "s15_field_census": BASE + " UNION ALL ".join(f"SELECT count(*) AS n_rows, '{c}' AS \"column\", count({c}) AS n_non_null FROM ledger" for c in _COLUMNS),
    "d7_months_at_risk": BASE + _RISK + " SELECT * FROM risk",
    "d11_tax_residuals": BASE + """
SELECT a.entity, a.month, g.taxable_value - a.fees AS residual, abs(g.taxable_value - a.fees) <= greatest(1, a.n_rows) AS rounding
FROM accrued a JOIN gst g ON g.entity = a.entity AND g.filing_period = a.month""",
    "j12_supplier": BASE + """
, h AS (SELECT a.entity, g.gstin, count(*) AS hits FROM accrued a JOIN gst g ON g.entity = a.entity AND abs(g.taxable_value - a.fees) <= greatest(1, a.n_rows) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY hits DESC, gstin) AS n FROM h)
SELECT entity, gstin, hits FROM r WHERE n = 1""",
    "w1_processing_order": BASE + "SELECT bank_index, entity, row_number() OVER (PARTITION BY entity ORDER BY value_day, bank_index) AS seq FROM bank",
    "w4_rivals": BASE + """
SELECT entity, bank_index, CAST(count(*) OVER (PARTITION BY entity, amount) - coalesce(sum(CASE WHEN reference <> '' THEN 1 ELSE 0 END)
  OVER (PARTITION BY entity, amount ORDER BY value_day, bank_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS BIGINT) AS rivals FROM bank WHERE amount > 0""",
    "w10_separators": BASE + """
, t AS (SELECT count(*) AS size FROM ledger WHERE type = 'refund'),
r AS (SELECT type, count(*) OVER (ORDER BY amount) AS up, count(*) OVER (ORDER BY amount DESC) AS down FROM ledger)
SELECT max(size) AS size, count(CASE WHEN type = 'refund' AND up <= size THEN 1 END) AS in_lowest, count(CASE WHEN type = 'refund' AND down <= size THEN 1 END) AS in_highest FROM r, t""",
    "w11_dense_references": BASE + """
SELECT entity, count(*) AS n, max(ord) - min(ord) + 1 = count(*) AS dense FROM settlements GROUP BY 1""",
    "w12_fifo_under_cap": BASE.replace("WITH o AS", "WITH RECURSIVE o AS") + """
, q AS (SELECT entity, row_id, credit, row_number() OVER (PARTITION BY entity ORDER BY created_at, row_id) AS n FROM ledger WHERE credit > 0),
w AS (SELECT entity, n, row_id, CASE WHEN credit <= 50000000 THEN credit ELSE 0 END AS total, credit <= 50000000 AS taken FROM q WHERE n = 1
  UNION ALL SELECT q.entity, q.n, q.row_id, w.total + CASE WHEN w.total + q.credit <= 50000000 THEN q.credit ELSE 0 END, w.total + q.credit <= 50000000 FROM w JOIN q ON q.entity = w.entity AND q.n = w.n + 1)
SELECT entity, row_id, total FROM w WHERE taken""",
    "w13_debits_deferred": BASE + """
, p AS (SELECT entity, settlement_id, row_id, debit * 3 AS debit, sum(credit - debit * 3) OVER (PARTITION BY settlement_id) AS payout FROM ledger WHERE settlement_id IS NOT NULL),
d AS (SELECT *, row_number() OVER w AS n, sum(debit) OVER (w ROWS UNBOUNDED PRECEDING) AS back FROM p WHERE debit > 0 WINDOW w AS (PARTITION BY settlement_id ORDER BY debit DESC, row_id))
SELECT entity, settlement_id, min(n) AS n_deferred, CAST(max(payout) AS BIGINT) AS payout FROM d WHERE payout < 0 AND payout + back >= 0 GROUP BY 1, 2""",
    "q5_ks_distance": BASE + """
, t AS (SELECT sum(CASE WHEN type = 'refund' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN type <> 'refund' THEN 1 ELSE 0 END) AS nb FROM ledger),
r AS (SELECT sum(CASE WHEN type = 'refund' THEN 1 ELSE 0 END) OVER (ORDER BY created_at) AS a, sum(CASE WHEN type <> 'refund' THEN 1 ELSE 0 END) OVER (ORDER BY created_at) AS b FROM ledger)
SELECT CAST(max(abs(CAST(a AS BIGINT) * 1000000 // CAST(na AS BIGINT) - CAST(b AS BIGINT) * 1000000 // CAST(nb AS BIGINT))) AS BIGINT) AS ks_millionths FROM r, t""",
    "t6_common_levels": BASE + """
, n AS (SELECT type, method, count(*) AS n FROM ledger GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, method) AS r FROM n)
SELECT type, method, n, r FROM r WHERE r <= 40""",
    "t8_announced_truncation": BASE + """
, r AS (SELECT entity, row_id, row_number() OVER (PARTITION BY entity ORDER BY row_id) AS n FROM ledger)
SELECT entity, string_agg(CASE WHEN n <= 12 THEN row_id END, ',' ORDER BY row_id) AS sample, count(*) AS total, count(*) > 12 AS truncated FROM r GROUP BY 1""",
}
