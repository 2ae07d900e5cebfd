"""Audit, storage, text and ingest queries and their SQL."""

from pyspark.sql import functions as F

from ..functions import calendar, money, text
from ..operators import audit as Q
from ..operators import dispositions as D
from ..operators import joins as J
from ..operators import store as ST
from ..operators import windows as W
from ..operators.storage import kept, place
from ..streaming import breaks as BR
from ..streaming import ingest as I
from . import fixtures as X
from . import resolution as RES
from .fixtures import BASE


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def q2_predicate_scores(spark, sf):
    return Q.predicate_scores(X.ledger(spark, sf), "type = 'refund'", ["method", "on_hold", "dispute_id", "tax", "payment_id"])


def q3_pair_scores(spark, sf):
    return Q.pair_scores(X.ledger(spark, sf), "type = 'refund'", ["method", "on_hold"])


def q6_dependencies(spark, sf):
    return Q.functional_dependencies(X.ledger(spark, sf), ["order_id", "entity", "settlement_id", "method"])


def q6_derivable_sums(spark, sf):
    rows = X.ledger(spark, sf).where("type = 'payment' AND fee IS NOT NULL").withColumn("charges", F.col("fee") + F.col("tax"))
    return Q.derivable_sums(rows, "credit", ["amount", "fee", "tax", "charges"])


def q7_collisions(spark, sf):
    return Q.value_collisions(X.ledger(spark, sf).where("credit > 0"), "entity", "credit")


def f1_money(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.format_string("%.2f", F.col("o_totalprice")).alias("t"))
    return o.select("o_orderkey", money.paise(F.col("t")).alias("paise"), money.rupees(-money.paise(F.col("t"))).alias("negative"), money.inr(money.paise(F.col("t"))).alias("shown"), money.try_paise(F.concat("t", F.lit("5"))).alias("refused"))


def f9_age_buckets(spark, sf):
    rows = X.ledger(spark, sf)
    return rows.select("row_id", ST.age_of(money.div(F.col("created_at"), 86_400), F.lit(10_300)).alias("bucket"), calendar.month_of(calendar.local_day(F.col("created_at"))).alias("month"))


def f13_check_characters(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    body = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0"), F.lit("F1Z"))
    return c.select("c_custkey", body.alias("body"), text.gstin_check(body).alias("check"))


def f14_trailing_numbers(spark, sf):
    return X.ledger(spark, sf).select("row_id", text.trailing_number(F.col("row_id")).alias("number"), F.array_join(text.tokens(F.concat_ws(" ", "row_id", "method")), ",").alias("tokens"))


def f15_digests(spark, sf):
    rows = X.ledger(spark, sf)
    month = F.call_function("div", F.col("created_at"), F.lit(30 * 86_400))
    return W.fingerprints(rows, "entity", month, F.concat_ws(":", "row_id", F.col("credit").cast("string")))


def k1_run_ids(spark, sf):
    """Runs that aren't stored yet: those of the first market segments are."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    runs = c.select("c_mktsegment", ST.run_id(F.col("c_mktsegment"), F.lit("code"), F.lit(200), F.lit(10)).alias("run_id"))
    return ST.new_runs(runs, runs.where("c_mktsegment < 'B'").select("run_id").distinct()).select("c_mktsegment", "run_id")


def k2_flattened(spark, sf):
    return ST.flattened(RES.r4_tier_outcomes(spark, sf)).select("entity", "bank_index", "kind", "reason", F.get_json_object("outcome", "$.tier").alias("tier"))


def _sightings(spark, sf):
    """Runs are days of the month modulo 9; a row is seen open where its key says so."""
    o = X.orders(spark, sf).select("entity", F.concat(F.lit("pay_"), "k").alias("row_id"), "k")
    runs = o.select("entity").distinct().withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("seq", F.col("seq").cast("long"))
    seen = o.join(runs, "entity").where("(k * seq) % 7 < 3").select("entity", "row_id", "seq")
    return seen, runs


def x4_break_spans(spark, sf):
    return ST.break_spans(*_sightings(spark, sf))


def x4_streamed_spans(spark, sf):
    """The spans of ``x4_break_spans`` by a stream that goes on three times where it stopped, three runs at a time."""
    seen, runs = _sightings(spark, sf)
    path = place(spark, "break-stream")
    both = kept(seen.select("entity", "seq", "row_id").unionByName(runs.select("entity", "seq", F.lit(None).cast("string").alias("row_id"))), "sightings")
    for first in (1, 4, 7):
        both.where(F.col("seq").between(first, first + 2)).write.mode("append").parquet(f"{path}/in")
        BR.follow(spark.readStream.schema(both.schema).parquet(f"{path}/in"), f"{path}/changes", f"{path}/state", buckets=2)
    return BR.spans(spark.read.parquet(f"{path}/changes"), runs)


def w6_row_history(spark, sf):
    seen, runs = _sightings(spark, sf)
    every = X.orders(spark, sf).select("entity", F.concat(F.lit("pay_"), "k").alias("row_id")).join(runs, "entity")
    states = every.join(seen.withColumn("open", F.lit("open")), ["entity", "row_id", "seq"], "left").select("row_id", "seq", F.coalesce("open", F.lit("closed")).alias("state"))
    return ST.row_history(states)


def st4_open_by_bucket(spark, sf):
    return ST.open_by_bucket(RES.d5_dispositions(spark, sf))


def st9_escalations(spark, sf):
    return ST.escalations(RES.d5_dispositions(spark, sf))


def st7_approvals(spark, sf):
    e = _events(spark, sf)
    action = F.element_at(F.array(*map(F.lit, ("create", "approved", "rejected", "create"))), (F.col("event_id") % 4 + 1).cast("int"))
    return ST.approval_states(e.select((F.col("event_id") % 997).alias("request_id"), action.alias("action"), F.col("event_id").alias("at")))


def p11_grid_filter(spark, sf):
    lines = X.bank(X.ledger(spark, sf))
    decided = RES.r4_tier_outcomes(spark, sf).select("entity", "bank_index", "kind")
    return ST.filtered_lines(lines.join(decided, ["entity", "bank_index"]), "verified over 200000 utr_1").select("bank_index", "reference", "amount", "kind")


def p13_entity_status(spark, sf):
    return ST.entity_status(RES.r4_tier_outcomes(spark, sf))


def j14_enriched_exceptions(spark, sf):
    """Discrepant lines with what every source says of them."""
    rows = X.ledger(spark, sf)
    d = RES.r4_tier_outcomes(spark, sf).where("kind = 'discrepancy'")
    n = rows.where("settlement_id IS NOT NULL").groupBy("entity", "settlement_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("dispute_id").alias("n_disputed"), F.sum(F.col("credit") - F.col("debit")).alias("net"))
    book = rows.join(X.erp(spark, sf).select("entity", "order_id", "invoice_no"), ["entity", "order_id"]).groupBy("entity", "settlement_id").agg(F.count_distinct("invoice_no").alias("n_invoices"))
    return d.join(n, ["entity", "settlement_id"], "left").join(book, ["entity", "settlement_id"], "left").select("entity", "bank_index", "reason", "settlement_id", "n_rows", "n_disputed", "net", F.coalesce("n_invoices", F.lit(0)).alias("n_invoices"))


def t1_largest_exceptions(spark, sf):
    lines = X.bank(X.ledger(spark, sf))
    d = RES.r4_tier_outcomes(spark, sf).where("kind = 'discrepancy'").join(lines.select("entity", "bank_index", "amount"), ["entity", "bank_index"])
    return d.orderBy(F.desc(F.abs("amount")), "bank_index").limit(5).select("bank_index", "amount", "reason")


def x1_ingest_once(spark, sf):
    """Payloads by digest, whatever their name, and what becomes of them."""
    e = _events(spark, sf).select(F.col("event_id").cast("string").alias("name"), F.concat_ws("|", "event_type", "user_id").alias("payload"))
    good, bad = I.accepted_and_quarantined(e, ~F.col("payload").startswith("purchase"))
    tag = lambda df, s: df.select("sha256", F.lit(s).alias("state"))
    return tag(good, "accepted").unionByName(tag(bad, "quarantined"))


def x1_streamed_ingest(spark, sf):
    """The payloads of ``x1_ingest_once`` by a stream in two parts that share payloads."""
    e = kept(_events(spark, sf).select("event_id", F.col("event_id").cast("string").alias("name"), F.concat_ws("|", "event_type", "user_id").alias("payload")), "payloads")
    path = place(spark, "ingest-stream")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).select("name", "payload").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("name string, payload string").parquet(f"{path}/in")
        I.ingest(stream, f"{path}/good", f"{path}/bad", f"{path}/state", ~F.col("payload").startswith("purchase"))
    read = lambda d, s: spark.read.parquet(f"{path}/{d}").select("sha256", F.lit(s).alias("state"))
    return read("good", "accepted").unionByName(read("bad", "quarantined"))


def s9_json_props(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.to_json(F.try_parse_json("props")).isNotNull().alias("valid"), F.size(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))).cast("long").alias("n_keys"))


def d9_unmatched_payments(spark, sf):
    """Payments that neither the order book nor a settlement knows, by what they are."""
    rows = X.ledger(spark, sf)
    left = rows.where("type = 'payment' AND settlement_id IS NULL").join(J.ledger_to_erp(rows, X.erp(spark, sf)).where("status = 'matched'").select("entity", "order_id"), ["entity", "order_id"], "left_anti")
    kind = F.when(F.col("fee").isNull(), "failed").when(F.col("on_hold"), "on_hold").otherwise("pending")
    return left.groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("value"))


QUERIES = {f.__name__: f for f in (
    q2_predicate_scores, q3_pair_scores, q6_dependencies, q6_derivable_sums, q7_collisions, f1_money, f9_age_buckets, f13_check_characters, f14_trailing_numbers, f15_digests, k1_run_ids, k2_flattened,
    x4_break_spans, x4_streamed_spans, x1_streamed_ingest, w6_row_history, st4_open_by_bucket, st9_escalations, st7_approvals, p11_grid_filter, p13_entity_status, j14_enriched_exceptions, t1_largest_exceptions, x1_ingest_once, s9_json_props, d9_unmatched_payments)}
_T, _D = RES._TIERS, RES._DISPOSED
_SEEN = """
, runs AS (SELECT unnest(range(1, 10)) AS seq), seen AS (SELECT entity, 'pay_' || k AS row_id, seq FROM o, runs WHERE (k * seq) % 7 < 3)"""


def _predicates(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS level, type = 'refund' AS m FROM ledger" for c in columns)


def _dependency(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS determinant, '{b}' AS dependent, bool_and(one) AND count(*) * 2 < sum(n) AS holds FROM (SELECT {a}, count(*) AS n,
  count(DISTINCT {b}) + CASE WHEN count({b}) < count(*) THEN 1 ELSE 0 END <= 1 AS one FROM ledger WHERE {a} IS NOT NULL GROUP BY 1)"""


_CHECK = " + ".join(f"(({v}) * {1 + k % 2}) // 36 + (({v}) * {1 + k % 2}) % 36" for k in range(14) for v in [f"strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(body, {k + 1}, 1)) - 1"])
_FD = ["order_id", "entity", "settlement_id", "method"]
_PARTS = ["amount", "fee", "tax", "charges"]
_SUMS = [(a, b, s) for i, a in enumerate(_PARTS) for b in _PARTS[i + 1 :] for s in "+-"]
ORACLES = {
    "q2_predicate_scores": BASE + ", long AS (" + _predicates(["method", "on_hold", "dispute_id", "tax", "payment_id"]) + """),
n AS (SELECT col, level, count(*) AS support, sum(CASE WHEN m THEN 1 ELSE 0 END) AS hits FROM long GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY support DESC, level NULLS FIRST) AS r FROM n), t AS (SELECT sum(CASE WHEN type = 'refund' THEN 1 ELSE 0 END) AS size, count(*) AS al FROM ledger)
SELECT col AS "column", level, support, CAST(hits AS BIGINT) AS hits, CAST(hits * 10000 // support AS BIGINT) AS precision_bp, CAST(hits * 10000 // size AS BIGINT) AS recall_bp,
  hits * 10000 // support >= 9000 AND hits * 10000 // size >= 5000 AND hits * al >= 2 * support * size AS leaks
FROM r, t WHERE r <= 40""",
    "q3_pair_scores": BASE + """
SELECT 'method' AS c1, method AS l1, 'on_hold' AS c2, CAST(on_hold AS VARCHAR) AS l2, count(*) AS support, CAST(sum(CASE WHEN type = 'refund' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ledger GROUP BY method, on_hold""",
    "q6_dependencies": BASE + " UNION ALL ".join(_dependency(a, b) for a in _FD for b in _FD if a != b),
    "q6_derivable_sums": BASE + ", p AS (SELECT *, fee + tax AS charges FROM ledger WHERE type = 'payment' AND fee IS NOT NULL)" + " UNION ALL ".join(
        f"SELECT count(*) AS n, '{a} {s} {b}' AS expression, count(CASE WHEN credit = {a} {s} {b} THEN 1 END) AS hits FROM p" for a, b, s in _SUMS),
    "q7_collisions": BASE + "SELECT entity, credit, count(*) AS n FROM ledger WHERE credit > 0 GROUP BY 1, 2 HAVING count(*) > 1",
    "f1_money": """WITH p AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)
SELECT o_orderkey, p AS paise, CASE WHEN p > 0 THEN '-' ELSE '' END || (p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS negative,
  '₹' || regexp_replace(CAST(p // 100 AS VARCHAR), '([0-9])([0-9][0-9][0-9])$', '\\1,\\2') || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS shown, CAST(NULL AS BIGINT) AS refused FROM p""",
    "f9_age_buckets": BASE + """
, a AS (SELECT row_id, created_at, greatest(0, 10300 - created_at // 86400) AS age FROM ledger)
SELECT row_id, CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '90+' END AS bucket, strftime(DATE '1970-01-01' + CAST((created_at + 19800) // 86400 AS INTEGER), '%Y-%m') AS month FROM a""",
    "f13_check_characters": f"""WITH b AS (SELECT c_custkey, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z' AS body FROM customer),
t AS (SELECT *, {_CHECK} AS total FROM b)
SELECT c_custkey, body, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - total % 36) % 36 + 1 AS INTEGER), 1) AS "check" FROM t""",
    "f14_trailing_numbers": BASE + """
SELECT row_id, CAST(string_split(row_id, '_')[2] AS BIGINT) AS number,
  array_to_string(list_sort(list_distinct(list_filter(string_split(replace(row_id, '_', ' ') || ' ' || method, ' '), lambda w: length(w) BETWEEN 3 AND 40))), ',') AS tokens FROM ledger""",
    "f15_digests": BASE + """
, c AS (SELECT entity, created_at // 2592000 AS c, sha256(string_agg(row_id || ':' || credit, '|' ORDER BY row_id || ':' || credit)) AS d FROM ledger GROUP BY 1, 2)
SELECT entity, sha256(string_agg(d, '|' ORDER BY c)) AS fingerprint FROM c GROUP BY 1""",
    "k1_run_ids": "SELECT DISTINCT c_mktsegment, sha256(c_mktsegment || '|code|200|10') AS run_id FROM customer WHERE c_mktsegment >= 'B'",
    "k2_flattened": BASE + _T + "SELECT entity, bank_index, kind, reason, tier FROM decided",
    "x4_break_spans": BASE + _SEEN + """
, s AS (SELECT *, seq - row_number() OVER (PARTITION BY row_id ORDER BY seq) AS g FROM seen)
SELECT entity, row_id, min(seq) AS opened_seq, max(seq) AS last_seen_seq, CASE WHEN max(seq) < 9 THEN max(seq) + 1 END AS closed_seq FROM s GROUP BY entity, row_id, g""",
    "w6_row_history": BASE + _SEEN + """
, st AS (SELECT 'pay_' || k AS row_id, seq, CASE WHEN (k * seq) % 7 < 3 THEN 'open' ELSE 'closed' END AS state FROM o, runs), h AS (SELECT *, lag(state) OVER (PARTITION BY row_id ORDER BY seq) AS before FROM st)
SELECT row_id, seq, before, state AS after FROM h WHERE before IS NULL OR before <> state""",
    "st4_open_by_bucket": BASE + _T + _D + """
, n AS (SELECT unnest(['0-30', '31-60', '61-90', '90+']) AS bucket) SELECT n.bucket, count(b.reason) AS n, max(b.age_days) AS oldest FROM n LEFT JOIN (SELECT * FROM bucketed WHERE reason IS NOT NULL) b USING (bucket) GROUP BY 1""",
    "st9_escalations": BASE + _T + _D + """
, n AS (SELECT reason, bucket, count(*) AS n FROM bucketed WHERE reason IN ('upstream_unresolved', 'unexplained') GROUP BY 1, 2)
SELECT reason, bucket, n, CASE WHEN reason = 'unexplained' AND bucket = '0-30' OR reason = 'upstream_unresolved' AND bucket IN ('0-30', '31-60') THEN 'notify' ELSE 'escalate' END AS action,
  CASE reason WHEN 'unexplained' THEN 'investigation' ELSE 'whoever owns the causing finding' END AS owner,
  CASE reason WHEN 'unexplained' THEN '-- no close condition is known, which is the point' ELSE 'the causing bank line becomes Verified or ProvenUnmatched' END AS closes_when FROM n""",
    "st7_approvals": """WITH e AS (SELECT event_id % 997 AS request_id, CASE event_id % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'create' END AS action, event_id AS moment FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY moment) AS n FROM e WHERE action <> 'create'), c AS (SELECT request_id, min(moment) AS created_at FROM e WHERE action = 'create' GROUP BY 1)
SELECT c.request_id, c.created_at, coalesce(d.action, 'pending') AS status, d.moment AS resolved_at FROM c LEFT JOIN d ON d.request_id = c.request_id AND d.n = 1""",
    "p11_grid_filter": BASE + _T + "SELECT d.bank_index, b.reference, b.amount, d.kind FROM decided d JOIN bank b USING (bank_index) WHERE d.kind = 'verified' AND abs(b.amount) > 20000000 AND contains(b.reference, 'utr_1')",
    "p13_entity_status": BASE + _T + """SELECT entity, CASE WHEN count(CASE WHEN kind = 'verified' THEN 1 END) = 0 THEN 'not_started' WHEN count(CASE WHEN kind = 'verified' THEN 1 END) = count(*) THEN 'certified'
  WHEN count(CASE WHEN kind = 'discrepancy' THEN 1 END) > 0 THEN 'awaiting_approval' ELSE 'in_progress' END AS status FROM decided GROUP BY 1""",
    "j14_enriched_exceptions": BASE + _T + """
, n AS (SELECT settlement_id, count(*) AS n_rows, count(dispute_id) AS n_disputed, CAST(sum(credit - debit) AS BIGINT) AS net FROM ledger WHERE settlement_id IS NOT NULL GROUP BY 1),
i AS (SELECT l.settlement_id, count(DISTINCT invoice_no) AS n_invoices FROM ledger l JOIN erp e ON e.order_id = l.order_id WHERE l.settlement_id IS NOT NULL GROUP BY 1)
SELECT d.entity, d.bank_index, d.reason, d.settlement_id, n.n_rows, n.n_disputed, n.net, coalesce(i.n_invoices, 0) AS n_invoices FROM decided d LEFT JOIN n ON n.settlement_id = d.settlement_id LEFT JOIN i ON i.settlement_id = d.settlement_id WHERE d.kind = 'discrepancy'""",
    "t1_largest_exceptions": BASE + _T + "SELECT bank_index, amount, reason FROM decided WHERE kind = 'discrepancy' ORDER BY abs(amount) DESC, bank_index LIMIT 5",
    "x1_ingest_once": "SELECT DISTINCT sha256(event_type || '|' || user_id) AS sha256, CASE WHEN event_type LIKE 'purchase%' THEN 'quarantined' ELSE 'accepted' END AS state FROM events",
    "s9_json_props": "SELECT event_id, json_valid(props) AS valid, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events",
    "d9_unmatched_payments": BASE + """
SELECT CASE WHEN fee IS NULL THEN 'failed' WHEN on_hold THEN 'on_hold' ELSE 'pending' END AS state, count(*) AS n, CAST(sum(amount) AS BIGINT) AS value
FROM ledger WHERE type = 'payment' AND settlement_id IS NULL AND NOT (fee IS NOT NULL AND order_id IN (SELECT order_id FROM erp)) GROUP BY 1""",
}
ORACLES |= {"x4_streamed_spans": ORACLES["x4_break_spans"], "x1_streamed_ingest": ORACLES["x1_ingest_once"]}
