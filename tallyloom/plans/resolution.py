"""Resolver, subset-sum, disposition and scoring queries and their SQL."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dispositions as D
from ..operators import gates as G
from ..operators import joins as J
from ..operators import resolver as R
from ..operators import subsets as S
from ..operators import windows as W
from ..operators.storage import kept
from . import fixtures as X
from .fixtures import BASE


def _books(spark, sf):
    """Ledger, lines and report, written once: the tiers read each of them several times."""
    rows = kept(X.ledger(spark, sf), "ledger")
    settled = kept(X.settlements(rows), "settlements")
    return rows, kept(X.bank_of(settled), "lines"), X.report_of(settled)


def _decided(spark, sf):
    rows, lines, report = _books(spark, sf)
    return rows, lines, R.tiers_a_and_b(rows, lines, report).withColumn("kind", F.coalesce("kind", F.lit("open")))


def _pools(spark, sf):
    """A customer's whole settlements as the pool of each credit line."""
    rows = X.ledger(spark, sf)
    pool = X.settlements(rows).select("entity", F.col("settlement_id").alias("row_id"), "net")
    lines = X.bank(rows).where("amount > 0").select("entity", "bank_index", F.col("amount").alias("target"))
    return kept(lines.join(pool, "entity"), "pools")  # the search reads them three times


def _candidates(spark, sf):
    """Sets of whole settlements that add up to a credit line."""
    return S.enumerate_lines(_pools(spark, sf))


def _truth(rows):
    return X.answer_key(rows).select("entity", "bank_index", "line_kind", "settlement_id")


def a7_outcome_accounting(spark, sf):
    return A.outcome_accounting(_decided(spark, sf)[2])


def r4_tier_outcomes(spark, sf):
    return _decided(spark, sf)[2].select("entity", "bank_index", "tier", "kind", "reason", "settlement_id")


def r6_resolved(spark, sf):
    rows, lines, report = _books(spark, sf)
    return R.resolve(rows, lines, report).groupBy("tier", "kind", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def c1_row_subsets(spark, sf):
    """Sets of eligible ledger rows that close each line which tiers A and B leave open."""
    rows, lines, report = _books(spark, sf)
    decided = kept(R.tiers_a_and_b(rows, lines, report), "decided")
    return R.searched(rows, decided.where("kind IS NULL"), R.consumed_by(decided)).select("entity", "bank_index", "row_ids", "n_debits", "credit", "complete", "status")


def c1_nation_pools(spark, sf):
    """Sets of a nation's settlements, thousands of them, that add up to its largest bank credit."""
    nation = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("nation"))
    rows = X.ledger(spark, sf)
    pool = X.settlements(rows).join(nation, "entity").select("nation", F.col("settlement_id").alias("row_id"), "net")
    line = X.bank(rows).join(nation, "entity").groupBy("nation").agg(F.max(F.struct("amount", "bank_index")).alias("line"))
    pools = line.select("nation", "line.bank_index", F.col("line.amount").alias("target")).join(pool, "nation").withColumnRenamed("nation", "entity")
    return S.enumerate_lines(pools)


def r7_rival_closures(spark, sf):
    rows, lines, report = _books(spark, sf)
    return R.rival_closures(rows, kept(R.tiers_a_and_b(rows, lines, report), "decided"))


def r8_compositions(spark, sf):
    rows, _, d = _decided(spark, sf)
    return R.compositions(rows, d).withColumns({c: F.array_join(c, "|") for c in ("credit_ids", "debit_ids")})


def r4_attested_rows(spark, sf):
    rows, _, d = _decided(spark, sf)
    return R.attested_rows(rows, d)


def p6_pool_bounds(spark, sf):
    rows = X.ledger(spark, sf)
    return R.pool_bounds(rows, X.bank(rows))


def a18_kpis(spark, sf):
    return A.kpis(_decided(spark, sf)[2])


def c1_closing_subsets(spark, sf):
    return _candidates(spark, sf).where("candidate IS NOT NULL").select("entity", "bank_index", "row_ids", "n_debits", "credit")


def c2_fewest_deferred(spark, sf):
    return S.fewest_deferred(_pools(spark, sf)).where("candidate IS NOT NULL").select("entity", "bank_index", "row_ids", "n_debits")


def c3_verdicts(spark, sf):
    return S.verdicts(_candidates(spark, sf)).select("entity", "bank_index", "n_candidates", "verdict")


def u1_common_and_contested(spark, sf):
    return S.common_and_contested(_candidates(spark, sf))


def w5_collisions(spark, sf):
    c = _candidates(spark, sf).where("candidate = 0")
    lines = X.bank(X.ledger(spark, sf)).select("entity", "bank_index", (F.col("reference") != "").alias("verified"))
    claims = c.join(lines, ["entity", "bank_index"]).select("entity", "bank_index", F.explode(F.split("row_ids", "[|]")).alias("row_id"), "verified")
    return W.collisions(claims)


def w9_ranked_candidates(spark, sf):
    return W.ranked_candidates(_candidates(spark, sf).where("candidate IS NOT NULL")).select("entity", "bank_index", "row_ids", F.col("rank").cast("long").alias("rank"))


def d3_proven(spark, sf):
    return D.proven(X.ledger(spark, sf)).where("proven IS NOT NULL")


def _dispositions(spark, sf):
    rows, lines, decided = _decided(spark, sf)
    decided = kept(decided, "decided")  # read three times
    return D.dispositions(rows, lines, decided, R.first_cause(decided, rows), X.disputes(spark, sf))


def d5_dispositions(spark, sf):
    return _dispositions(spark, sf)


def d5_breaks(spark, sf):
    return D.breaks(_dispositions(spark, sf))


def d6_routed_breaks(spark, sf):
    return D.routed(D.grouped(_dispositions(spark, sf)))


def g1_wrong_claims(spark, sf):
    rows = X.ledger(spark, sf)
    naive = A.naive_matches(rows, X.bank(rows))
    return G.wrong_claims(naive, _truth(rows))


def g3_truth_missing(spark, sf):
    return G.truth_missing(_candidates(spark, sf), _truth(X.ledger(spark, sf)))


def g7_abstentions(spark, sf):
    rows, _, decided = _decided(spark, sf)
    return G.abstentions(decided, _truth(rows))


def g21_three_systems(spark, sf):
    """Match metrics of the grouping baseline, the reference join and the resolver."""
    rows, lines, decided = _decided(spark, sf)
    truth = _truth(rows)
    settled = X.settlements(rows).withColumn("reference", F.concat(F.lit("utr_"), F.substring("settlement_id", 6, 100)))
    systems = {"naive": A.naive_matches(rows, lines), "reference": J.batches_to_bank(settled, lines), "resolver": decided.where("kind = 'verified'")}
    out = None
    for name, claims in systems.items():
        one = G.match_metrics(claims, truth).withColumn("system", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def inv_violations(spark, sf):
    rows, _, decided = _decided(spark, sf)
    return G.violations(decided.where("kind <> 'open'"), rows).groupBy("invariant").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    a7_outcome_accounting, r4_tier_outcomes, r6_resolved, c1_row_subsets, c1_nation_pools, r7_rival_closures, r8_compositions, r4_attested_rows, p6_pool_bounds, a18_kpis, c1_closing_subsets, c2_fewest_deferred, c3_verdicts, u1_common_and_contested, w5_collisions,
    w9_ranked_candidates, d3_proven, d5_dispositions, d5_breaks, d6_routed_breaks, g1_wrong_claims, g3_truth_missing, g7_abstentions, g21_three_systems, inv_violations)}

_TIERS = """
, pairs AS (SELECT c.entity, c.bank_index AS ci, d.bank_index AS di, row_number() OVER (PARTITION BY d.bank_index ORDER BY c.value_day, c.bank_index) AS n
  FROM bank c JOIN bank d ON c.entity = d.entity AND c.amount = -d.amount AND c.amount > 0 AND d.value_day - c.value_day BETWEEN 0 AND 7),
named AS (SELECT *, row_number() OVER (PARTITION BY entity, reported_reference ORDER BY file_position DESC) AS n FROM report WHERE reported_reference <> ''),
x AS (SELECT b.*, r.settlement_id, r.reported_amount, s.net, s.last_created_at, (b.value_day + 1) * 86400 - 19800 AS ceiling,
    EXISTS (SELECT 1 FROM pairs p WHERE p.n = 1 AND p.di = b.bank_index) AS back, EXISTS (SELECT 1 FROM pairs p WHERE p.n = 1 AND p.ci = b.bank_index) AS reversed
  FROM bank b LEFT JOIN named r ON r.entity = b.entity AND r.reported_reference = b.reference AND r.n = 1
  LEFT JOIN settlements s ON s.entity = r.entity AND s.settlement_id = r.settlement_id),
same AS (SELECT b.bank_index, count(*) AS n, min(s.settlement_id) AS sid, min(s.last_created_at) AS last FROM bank b JOIN settlements s ON s.entity = b.entity AND s.net = b.amount GROUP BY 1),
w AS (SELECT x.*, same.n AS n, same.sid, same.last, CASE WHEN amount <= 0 THEN CASE WHEN back THEN 'OTHER' ELSE 'NOT_OUR_CREDIT' END WHEN reversed THEN 'CREDIT_REVERSED'
    WHEN settlement_id IS NULL THEN NULL WHEN reported_amount <> amount THEN 'CLAIMED_CREDIT_NOT_ON_STATEMENT' WHEN net <> amount THEN 'ATTESTED_COMPOSITION_DOES_NOT_CLOSE'
    WHEN last_created_at > ceiling THEN 'TEMPORAL_IMPOSSIBILITY' END AS why FROM x LEFT JOIN same USING (bank_index)),
decided AS (SELECT entity, bank_index, amount, value_day,
    CASE WHEN why IS NOT NULL OR settlement_id IS NOT NULL THEN 'A' WHEN coalesce(n, 0) = 0 THEN 'C' ELSE 'B' END AS tier,
    CASE WHEN why IN ('OTHER', 'NOT_OUR_CREDIT') THEN 'unresolved' WHEN why IS NOT NULL THEN 'discrepancy' WHEN settlement_id IS NOT NULL THEN 'verified'
      WHEN coalesce(n, 0) = 0 THEN 'open' WHEN n > 1 THEN 'ambiguous' WHEN last > ceiling THEN 'discrepancy' ELSE 'verified' END AS kind,
    CASE WHEN why IS NOT NULL THEN why WHEN settlement_id IS NULL AND n = 1 AND last > ceiling THEN 'TEMPORAL_IMPOSSIBILITY' END AS reason,
    CASE WHEN why IS NOT NULL OR settlement_id IS NOT NULL THEN settlement_id WHEN n = 1 THEN sid END AS settlement_id FROM w)
"""
_SUBSETS = """
, num AS (SELECT entity, settlement_id, net, row_number() OVER (PARTITION BY entity ORDER BY settlement_id) AS i FROM settlements),
sub AS (SELECT entity, i AS last, settlement_id AS row_ids, net AS total, CASE WHEN net < 0 THEN 1 ELSE 0 END AS n_debits, greatest(net, 0) AS credit FROM num
  UNION ALL SELECT s.entity, n.i, s.row_ids || '|' || n.settlement_id, s.total + n.net, s.n_debits + CASE WHEN n.net < 0 THEN 1 ELSE 0 END, s.credit + greatest(n.net, 0)
  FROM sub s JOIN num n ON n.entity = s.entity AND n.i > s.last),
cand AS (SELECT b.entity, b.bank_index, s.row_ids, s.n_debits, s.credit, b.reference FROM bank b JOIN sub s ON s.entity = b.entity AND s.total = b.amount WHERE b.amount > 0)
"""
_REC = BASE.replace("WITH o AS", "WITH RECURSIVE o AS") + _SUBSETS
_TRUTH = """
, truth AS (SELECT entity, bank_index, line_kind, settlement_id FROM answer)"""
_NAIVE = """
, na AS (SELECT *, count(*) OVER (PARTITION BY entity, net) AS n FROM settlements), nb AS (SELECT *, count(*) OVER (PARTITION BY entity, amount) AS n FROM bank),
naive AS (SELECT na.entity, na.settlement_id, nb.bank_index FROM na JOIN nb ON na.entity = nb.entity AND na.net = nb.amount WHERE na.n = 1 AND nb.n = 1)"""
_PROVEN = """
, rf AS (SELECT payment_id, sum(debit) AS refunded, max(created_at) AS last FROM ledger WHERE type = 'refund' GROUP BY 1),
net AS (SELECT p.row_id FROM ledger p JOIN rf ON rf.payment_id = p.row_id WHERE rf.refunded = p.amount AND rf.last <= ((p.created_at + 19800) // 86400
  + CASE WHEN ((p.created_at + 19800) // 86400 + 4) % 7 IN (4, 5) THEN 4 WHEN ((p.created_at + 19800) // 86400 + 4) % 7 = 6 THEN 3 ELSE 2 END) * 86400 + 39600 - 19800),
proven AS (SELECT entity, row_id, CASE WHEN type = 'payment' AND credit = 0 THEN 'NOT_CAPTURED' WHEN coalesce(payment_id, row_id) IN (SELECT row_id FROM net) THEN 'NETTED_OUT' END AS proven FROM ledger)"""
_DISPOSED = _PROVEN + """
, hz AS (SELECT entity, max(value_day) AS horizon FROM bank GROUP BY 1),
cause AS (SELECT entity, settlement_id, min(bank_index) AS caused_by FROM decided WHERE kind <> 'verified' AND settlement_id IS NOT NULL GROUP BY 1, 2),
u AS (SELECT l.*, p.proven, c.caused_by, h.horizon, (l.created_at + 19800) // 86400 AS d FROM ledger l JOIN proven p ON p.row_id = l.row_id JOIN hz h ON h.entity = l.entity
  LEFT JOIN cause c ON c.settlement_id = l.settlement_id WHERE l.settlement_id IS NULL OR l.settlement_id NOT IN (SELECT settlement_id FROM decided WHERE kind = 'verified')),
v AS (SELECT *, CASE WHEN type = 'payment' THEN d + CASE WHEN (d + 4) % 7 IN (4, 5) THEN 4 WHEN (d + 4) % 7 = 6 THEN 3 ELSE 2 END ELSE d END AS since FROM u),
disposed AS (SELECT entity, row_id, proven, credit - debit AS net, CASE WHEN proven IS NULL THEN CASE WHEN caused_by IS NOT NULL THEN 'upstream_unresolved' WHEN type = 'payment' AND since > horizon THEN 'timing_difference'
    WHEN type = 'payment' AND (dispute_id IN (SELECT dispute_id FROM disputes) OR on_hold) THEN 'unexpected_change' ELSE 'unexplained' END END AS reason,
  CASE WHEN proven IS NULL THEN caused_by END AS caused_by, CASE WHEN proven IS NULL THEN greatest(0, horizon - since) END AS age_days, CASE WHEN proven IS NULL THEN since END AS first_seen FROM v),
bucketed AS (SELECT *, CASE WHEN age_days IS NULL THEN NULL WHEN age_days <= 30 THEN '0-30' WHEN age_days <= 60 THEN '31-60' WHEN age_days <= 90 THEN '61-90' ELSE '90+' END AS bucket, reason = 'timing_difference' AS provable FROM disposed)"""


def _metrics(system: str, claims: str) -> str:
    return f"""SELECT '{system}' AS system, count(CASE WHEN c.bank_index IS NOT NULL AND t.bank_index IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN t.bank_index IS NULL THEN 1 END) AS fp, count(CASE WHEN c.bank_index IS NULL THEN 1 END) AS fn
FROM (SELECT * FROM {claims}) c FULL JOIN (SELECT * FROM truth WHERE settlement_id IS NOT NULL) t ON c.entity = t.entity AND c.bank_index = t.bank_index AND c.settlement_id = t.settlement_id"""


ORACLES = {
    "a7_outcome_accounting": BASE + _TIERS + "SELECT kind, reason, count(*) AS n_lines, CAST(sum(abs(amount)) AS BIGINT) AS value FROM decided GROUP BY 1, 2",
    "r4_tier_outcomes": BASE + _TIERS + "SELECT entity, bank_index, tier, kind, reason, settlement_id FROM decided",
    "r8_compositions": BASE + _TIERS + """SELECT d.entity, d.bank_index, coalesce(string_agg(CASE WHEN credit > debit THEN row_id END, '|' ORDER BY row_id), '') AS credit_ids,
  coalesce(string_agg(CASE WHEN credit < debit THEN row_id END, '|' ORDER BY row_id), '') AS debit_ids, CAST(sum(greatest(credit - debit, 0)) AS BIGINT) AS credit_total, CAST(sum(greatest(debit - credit, 0)) AS BIGINT) AS debit_total
FROM decided d JOIN ledger l ON l.settlement_id = d.settlement_id WHERE d.kind = 'verified' GROUP BY 1, 2""",
    "r4_attested_rows": BASE + _TIERS + """SELECT d.entity, d.bank_index, d.reason, l.row_id, d.reason = 'TEMPORAL_IMPOSSIBILITY' AND l.created_at > (d.value_day + 1) * 86400 - 19800 AS offends
FROM decided d JOIN ledger l ON l.settlement_id = d.settlement_id WHERE d.kind = 'discrepancy'""",
    "p6_pool_bounds": BASE + """
, own AS (SELECT entity, CASE WHEN type = 'payment' THEN (lday + CASE WHEN (lday + 4) % 7 IN (4, 5) THEN 4 WHEN (lday + 4) % 7 = 6 THEN 3 ELSE 2 END) * 86400 + 39600 - 19800 ELSE created_at END AS from_at
  FROM (SELECT *, (created_at + 19800) // 86400 AS lday FROM ledger) WHERE credit <> debit AND (type <> 'payment' OR credit <> 0))
SELECT b.entity, b.bank_index, count(o.entity) AS bound FROM bank b LEFT JOIN own o ON o.entity = b.entity AND o.from_at <= (b.value_day + 1) * 86400 - 19800 GROUP BY 1, 2""",
    "a18_kpis": BASE + _TIERS + """, w2 AS (SELECT *, CASE WHEN kind = 'verified' THEN 1 ELSE 0 END AS v, CASE WHEN tier = 'A' AND settlement_id IS NOT NULL THEN 1 ELSE 0 END AS att FROM decided WHERE amount > 0)
SELECT entity, count(*) AS n_lines, CAST(sum(v) * 10000 // count(*) AS BIGINT) AS straight_through_bp, CAST(sum(v) * 10000 // count(*) AS BIGINT) AS first_pass_bp, count(CASE WHEN kind = 'discrepancy' THEN 1 END) * 10000 // count(*) AS exception_bp,
CAST(sum(att) AS BIGINT) AS attested, CAST(CASE WHEN sum(att) > 0 THEN sum(att * v) * 10000 // sum(att) END AS BIGINT) AS on_attested_bp, CAST(sum(CASE WHEN v = 0 THEN amount ELSE 0 END) AS BIGINT) AS unreconciled FROM w2 GROUP BY 1""",
    "c1_closing_subsets": _REC + "SELECT entity, bank_index, row_ids, n_debits, credit FROM cand",
    "c2_fewest_deferred": _REC + ", r AS (SELECT *, max(n_debits) OVER (PARTITION BY bank_index) AS b FROM cand) SELECT entity, bank_index, row_ids, n_debits FROM r WHERE n_debits = b",
    "c3_verdicts": _REC + """SELECT b.entity, b.bank_index, count(c.row_ids) AS n_candidates, CASE count(c.row_ids) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'determinate' ELSE 'ambiguous' END AS verdict
FROM bank b LEFT JOIN cand c ON c.bank_index = b.bank_index WHERE b.amount > 0 GROUP BY 1, 2""",
    "u1_common_and_contested": _REC + """
, k AS (SELECT bank_index, count(*) AS k FROM cand GROUP BY 1), m AS (SELECT entity, bank_index, unnest(string_split(row_ids, '|')) AS row_id FROM cand),
n AS (SELECT entity, bank_index, row_id, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT n.entity, n.bank_index, coalesce(string_agg(CASE WHEN n = k THEN row_id END, '|' ORDER BY row_id), '') AS common, coalesce(string_agg(CASE WHEN n < k THEN row_id END, '|' ORDER BY row_id), '') AS contested
FROM n JOIN k USING (bank_index) GROUP BY 1, 2""",
    "w5_collisions": _REC + """
, first AS (SELECT *, row_number() OVER (PARTITION BY bank_index ORDER BY string_split(row_ids, '|')) AS n FROM cand),
m AS (SELECT entity, bank_index, reference <> '' AS verified, unnest(string_split(row_ids, '|')) AS row_id FROM first WHERE n = 1),
cl AS (SELECT *, count(*) OVER (PARTITION BY entity, row_id) AS n, sum(CASE WHEN verified THEN 1 ELSE 0 END) OVER (PARTITION BY entity, row_id) AS wins FROM m)
SELECT entity, bank_index, count(DISTINCT row_id) AS n_contested, bool_and(verified AND wins = 1) AS keeps FROM cl WHERE n > 1 GROUP BY 1, 2""",
    "w9_ranked_candidates": _REC + "SELECT entity, bank_index, row_ids, row_number() OVER (PARTITION BY bank_index ORDER BY n_debits DESC, credit DESC, row_ids) AS rank FROM cand",
    "d3_proven": BASE + _PROVEN + " SELECT * FROM proven WHERE proven IS NOT NULL",
    "d5_dispositions": BASE + _TIERS + _DISPOSED + " SELECT entity, row_id, proven, reason, caused_by, provable, age_days, first_seen, bucket, net FROM bucketed",
    "d5_breaks": BASE + _TIERS + _DISPOSED + " SELECT entity, reason, caused_by, provable, age_days, first_seen, count(*) AS n_rows, CAST(sum(net) AS BIGINT) AS net, min(row_id) AS first_row FROM bucketed WHERE reason IS NOT NULL GROUP BY ALL",
    "d6_routed_breaks": BASE + _TIERS + _DISPOSED + """
SELECT entity, reason, bucket, count(*) AS n_rows, CAST(sum(net) AS BIGINT) AS net, max(age_days) AS oldest,
  CASE reason WHEN 'upstream_unresolved' THEN 'whoever owns the causing finding' WHEN 'timing_difference' THEN 'none -- carry forward' WHEN 'unexpected_change' THEN 'disputes ops' WHEN 'unexplained' THEN 'investigation' END AS owner,
  CASE reason WHEN 'upstream_unresolved' THEN 'the causing bank line becomes Verified or ProvenUnmatched' WHEN 'timing_difference' THEN 'the item settles in a later window' WHEN 'unexpected_change' THEN 'the hold or reversal resolves'
    WHEN 'unexplained' THEN '-- no close condition is known, which is the point' END AS closes_when,
  CASE WHEN reason = 'unexplained' THEN CASE WHEN bucket = '0-30' THEN 'notify' ELSE 'escalate' END WHEN reason = 'upstream_unresolved' THEN CASE WHEN bucket IN ('0-30', '31-60') THEN 'notify' ELSE 'escalate' END ELSE 'none' END AS action
FROM bucketed WHERE reason IS NOT NULL GROUP BY entity, reason, bucket""",
    "g1_wrong_claims": BASE + _TRUTH + _NAIVE + " SELECT n.entity, n.bank_index, n.settlement_id, t.settlement_id AS true_settlement, t.line_kind FROM naive n JOIN truth t USING (bank_index) WHERE n.settlement_id IS DISTINCT FROM t.settlement_id",
    "g3_truth_missing": _REC + _TRUTH + """ SELECT c.entity, c.bank_index, count(*) AS n_candidates FROM cand c JOIN truth t ON t.bank_index = c.bank_index AND t.settlement_id IS NOT NULL
GROUP BY 1, 2 HAVING sum(CASE WHEN c.row_ids = t.settlement_id THEN 1 ELSE 0 END) = 0""",
    "g7_abstentions": BASE + _TIERS + _TRUTH + """ SELECT CASE d.kind WHEN 'verified' THEN 'verified' WHEN 'discrepancy' THEN 'contradicted' ELSE 'abstained' END AS state, count(*) AS n_lines
FROM truth t LEFT JOIN decided d USING (bank_index) WHERE t.settlement_id IS NOT NULL GROUP BY 1""",
    "g21_three_systems": BASE + _TIERS + _TRUTH + _NAIVE + """
, byref AS (SELECT s.entity, s.settlement_id, u.bank_index FROM settlements s JOIN (SELECT *, row_number() OVER (PARTITION BY entity, reference ORDER BY bank_index DESC) AS n FROM bank WHERE reference <> '') u
  ON u.entity = s.entity AND u.reference = 'utr_' || substr(s.settlement_id, 6) AND u.n = 1), ver AS (SELECT * FROM decided WHERE kind = 'verified'), m AS (
""" + " UNION ALL ".join(_metrics(*x) for x in (("naive", "naive"), ("reference", "byref"), ("resolver", "ver"))) + """)
SELECT *, CASE WHEN tp + fp = 0 THEN 10000 ELSE tp * 10000 // greatest(tp + fp, 1) END AS precision_bp, CASE WHEN tp + fn = 0 THEN 10000 ELSE tp * 10000 // greatest(tp + fn, 1) END AS recall_bp FROM m""",
    "inv_violations": BASE + _TIERS + """
, v AS (SELECT entity, 'verified_without_settlement' AS invariant FROM decided WHERE kind = 'verified' AND settlement_id IS NULL
UNION ALL SELECT entity, 'settlement_verified_twice' FROM decided WHERE kind = 'verified' GROUP BY entity, settlement_id HAVING count(*) > 1
UNION ALL SELECT entity, 'line_decided_twice' FROM decided WHERE kind <> 'open' GROUP BY entity, bank_index HAVING count(*) > 1)
SELECT invariant, count(*) AS n FROM v GROUP BY 1""",
}
