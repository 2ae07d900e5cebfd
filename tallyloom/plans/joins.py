"""Join queries over the derived books and their SQL."""

from pyspark.sql import functions as F

from ..functions import calendar, money
from ..operators import joins as J
from . import fixtures as X
from .fixtures import BASE


def _settled(rows):
    return _settled_of(X.settlements(rows))


def _settled_of(s):
    return s.withColumn("reference", F.concat(F.lit("utr_"), F.substring("settlement_id", 6, 100))).withColumn(
        "expected_day", money.div(F.col("last_created_at"), 86_400) + 3)


def j1_batch_to_bank(spark, sf):
    rows = X.ledger(spark, sf)
    return J.batches_to_bank(_settled(rows), X.bank(rows))


def j2_ledger_to_erp(spark, sf):
    return J.ledger_to_erp(X.ledger(spark, sf), X.erp(spark, sf))


def j3_line_to_report(spark, sf):
    rows = X.ledger(spark, sf)
    return J.lines_to_report(X.bank(rows), X.report(rows)).select("bank_index", "entity", "reference", "amount", "settlement_id", "reported_amount")


def j4_settlement_by_amount(spark, sf):
    rows = X.ledger(spark, sf)
    return J.settlements_by_amount(X.bank(rows), X.settlements(rows))


def j5_within_tolerance(spark, sf):
    rows = X.ledger(spark, sf)
    return J.within_tolerance(X.bank(rows), _settled(rows))


def _erp_gaps(spark, sf):
    rows, erp = X.ledger(spark, sf), X.erp(spark, sf)
    without = rows.where("type = 'payment' AND fee IS NOT NULL").join(erp.select("entity", "order_id"), ["entity", "order_id"], "left_anti")
    without = without.withColumn("day", money.div(F.col("created_at"), 86_400))
    orphans = erp.join(rows.where("type = 'payment'").select("entity", "order_id"), ["entity", "order_id"], "left_anti")
    return J.erp_gap_candidates(without, orphans, basis_points=2_000, days=900)


def j6_erp_gaps(spark, sf):
    return _erp_gaps(spark, sf).select("entity", "row_id", "order_id", "amount_gap", "reason")


def j6_scored_gaps(spark, sf):
    """Refused pairs with the gap in days and the likeness of their order ids."""
    return _erp_gaps(spark, sf).select("entity", "row_id", "order_id", "amount_gap", "day_gap", F.round("similarity", 6).alias("similarity"))


def j7_reversals(spark, sf):
    return J.reversals(X.bank(X.ledger(spark, sf)))


def j8_netted_out(spark, sf):
    return J.netted_out(X.ledger(spark, sf))


def d2_zero_net_groups(spark, sf):
    return J.netted_out(X.ledger(spark, sf), by_date=True)


def j15_run_difference(spark, sf):
    rows = X.ledger(spark, sf)
    state = lambda cut: rows.where(F.col("created_at") <= cut).select("row_id", F.when(F.col("settled_at") <= cut, "settled").otherwise("open").alias("state"))
    return J.run_difference(state(883_612_800), state(891_388_800), ["row_id"], "state").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def f3_eligibility(spark, sf):
    o = X.orders(spark, sf)
    day = calendar.local_day(F.col("created_at"))
    return o.select("k", calendar.eligible_at(F.col("created_at")).alias("eligible"), calendar.eligible_at(F.col("created_at"), calendar.SIMULATOR_HOUR).alias("eligible_simulator"),
                    calendar.end_of_day(day).alias("day_end"), calendar.add_working_days(day, 2).alias("two"), calendar.add_working_days(day, 7).alias("seven"))


QUERIES = {f.__name__: f for f in (
    j1_batch_to_bank, j2_ledger_to_erp, j3_line_to_report, j4_settlement_by_amount, j5_within_tolerance, j6_erp_gaps, j6_scored_gaps, j7_reversals,
    j8_netted_out, d2_zero_net_groups, j15_run_difference, f3_eligibility)}
ORACLES = {
    "j1_batch_to_bank": BASE + """
, u AS (SELECT *, row_number() OVER (PARTITION BY entity, reference ORDER BY bank_index DESC) AS n FROM bank WHERE reference <> '')
SELECT s.entity, s.settlement_id, u.reference, u.bank_index, s.net, u.amount AS bank_amount
FROM settlements s JOIN u ON u.entity = s.entity AND u.reference = 'utr_' || substr(s.settlement_id, 6) AND u.n = 1""",
    "j2_ledger_to_erp": BASE + """
SELECT entity, CASE WHEN order_id IN (SELECT order_id FROM erp) THEN 'matched' ELSE 'without_order' END AS status, order_id FROM ledger WHERE type = 'payment' AND fee IS NOT NULL
UNION ALL SELECT entity, 'without_payment', order_id FROM erp WHERE order_id NOT IN (SELECT order_id FROM ledger WHERE type = 'payment')""",
    "j3_line_to_report": BASE + """
, r AS (SELECT *, row_number() OVER (PARTITION BY entity, reported_reference ORDER BY file_position DESC) AS n FROM report WHERE reported_reference <> '')
SELECT b.bank_index, b.entity, b.reference, b.amount, r.settlement_id, r.reported_amount
FROM bank b LEFT JOIN r ON r.entity = b.entity AND r.reported_reference = b.reference AND r.n = 1""",
    "j4_settlement_by_amount": BASE + """
SELECT b.entity, b.bank_index, count(*) AS n_matches, string_agg(s.settlement_id, ',' ORDER BY s.settlement_id) AS settlement_ids
FROM bank b JOIN settlements s ON s.entity = b.entity AND s.net = b.amount WHERE b.amount > 0 GROUP BY 1, 2""",
    "j5_within_tolerance": BASE + """
SELECT b.entity, b.bank_index, s.settlement_id, s.net - b.amount AS difference, count(*) OVER (PARTITION BY b.entity, b.bank_index) AS n_candidates
FROM bank b JOIN settlements s ON s.entity = b.entity AND abs(s.net - b.amount) <= s.n_rows AND abs(s.last_created_at // 86400 + 3 - b.value_day) <= 1""",
    "j6_erp_gaps": BASE + """
, w AS (SELECT * FROM ledger WHERE type = 'payment' AND fee IS NOT NULL AND order_id NOT IN (SELECT order_id FROM erp)),
x AS (SELECT * FROM erp WHERE order_id NOT IN (SELECT order_id FROM ledger WHERE type = 'payment'))
SELECT w.entity, w.row_id, x.order_id, abs(w.amount - x.amount) AS amount_gap, 'no shared identifier' AS reason
FROM w JOIN x ON w.entity = x.entity AND abs(w.amount - x.amount) <= w.amount * 2000 // 10000 AND abs(w.created_at // 86400 - x.invoice_day) <= 900""",
    "j6_scored_gaps": BASE + """
, w AS (SELECT * FROM ledger WHERE type = 'payment' AND fee IS NOT NULL AND order_id NOT IN (SELECT order_id FROM erp)),
x AS (SELECT * FROM erp WHERE order_id NOT IN (SELECT order_id FROM ledger WHERE type = 'payment')),
p AS (SELECT w.entity, w.row_id, w.order_id AS a, x.order_id AS b, abs(w.amount - x.amount) AS amount_gap, abs(w.created_at // 86400 - x.invoice_day) AS day_gap
  FROM w JOIN x ON w.entity = x.entity AND abs(w.amount - x.amount) <= w.amount * 2000 // 10000 AND abs(w.created_at // 86400 - x.invoice_day) <= 900),
t AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda k: 0), list_transform(range(1, length(a) + 1), lambda i: [i])),
  lambda above, i: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda row, j: list_append(row, CASE WHEN substr(a, i[1], 1) = substr(b, j[1], 1) THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], row[-1]) END))) AS last FROM p)
SELECT entity, row_id, b AS order_id, amount_gap, day_gap, round(200.0 * last[-1] / (length(a) + length(b)), 6) AS similarity FROM t""",
    "j7_reversals": BASE + """
, p AS (SELECT c.entity, c.bank_index AS credit_index, d.bank_index AS debit_index, d.value_day - c.value_day AS days,
  row_number() OVER (PARTITION BY d.bank_index ORDER BY c.value_day, c.bank_index) AS n
  FROM bank c JOIN bank d ON c.entity = d.entity AND c.amount = -d.amount AND c.amount > 0 AND d.value_day - c.value_day BETWEEN 0 AND 7)
SELECT entity, credit_index, debit_index, days FROM p WHERE n = 1""",
    "j8_netted_out": BASE + """
, r AS (SELECT entity, payment_id, sum(debit) AS refunded, max(created_at) AS last_refund, count(*) AS n_refunds FROM ledger WHERE type = 'refund' GROUP BY 1, 2)
SELECT p.entity, p.row_id, CAST(r.refunded AS BIGINT) AS refunded, r.n_refunds FROM ledger p JOIN r ON r.payment_id = p.row_id AND p.type = 'payment'
WHERE r.refunded = p.amount AND r.last_refund <= ((p.created_at + 19800) // 86400 + CASE WHEN ((p.created_at + 19800) // 86400 + 4) % 7 IN (4, 5) THEN 4
  WHEN ((p.created_at + 19800) // 86400 + 4) % 7 = 6 THEN 3 ELSE 2 END) * 86400 + 39600 - 19800""",
    "d2_zero_net_groups": BASE + """
, r AS (SELECT entity, payment_id, sum(amount) AS refunded, max(created_at) AS last_refund, count(*) AS n_refunds FROM ledger WHERE type = 'refund' GROUP BY 1, 2)
SELECT p.entity, p.row_id, CAST(r.refunded AS BIGINT) AS refunded, r.n_refunds FROM ledger p JOIN r ON r.payment_id = p.row_id AND p.type = 'payment'
WHERE p.fee IS NOT NULL AND r.refunded = p.amount AND (r.last_refund + 19800) // 86400 <= (p.created_at + 19800) // 86400 + CASE WHEN ((p.created_at + 19800) // 86400 + 4) % 7 IN (4, 5) THEN 4
  WHEN ((p.created_at + 19800) // 86400 + 4) % 7 = 6 THEN 3 ELSE 2 END""",
    "j15_run_difference": BASE + """
, a AS (SELECT row_id, CASE WHEN settled_at <= 883612800 THEN 'settled' ELSE 'open' END AS state FROM ledger WHERE created_at <= 883612800),
b AS (SELECT row_id, CASE WHEN settled_at <= 891388800 THEN 'settled' ELSE 'open' END AS state FROM ledger WHERE created_at <= 891388800)
SELECT CASE WHEN a.state IS NULL THEN 'added' WHEN b.state IS NULL THEN 'removed' WHEN a.state <> b.state THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n
FROM a FULL JOIN b USING (row_id) GROUP BY 1""",
    "f3_eligibility": BASE + """
, days AS (SELECT DISTINCT lday FROM e), steps AS (SELECT unnest(range(1, 12)) AS i),
w AS (SELECT lday, lday + i AS d, row_number() OVER (PARTITION BY lday ORDER BY i) AS n FROM days, steps WHERE (lday + i + 4) % 7 NOT IN (0, 6)),
t AS (SELECT lday, max(CASE WHEN n = 2 THEN d END) AS two, max(CASE WHEN n = 7 THEN d END) AS seven FROM w GROUP BY lday)
SELECT k, two * 86400 + 39600 - 19800 AS eligible, two * 86400 + 61200 - 19800 AS eligible_simulator, (lday + 1) * 86400 - 19800 AS day_end, two, seven FROM e JOIN t USING (lday)""",
}
