"""Scores of claims against an answer key, each as the rows or counts that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wrong_claims(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Claimed lines whose settlement isn't the true one, foreign lines among them."""
    t = truth.select("entity", "bank_index", F.col("settlement_id").alias("true_settlement"), "line_kind")
    return claims.join(t, ["entity", "bank_index"]).where(~F.col("settlement_id").eqNullSafe(F.col("true_settlement"))).select("entity", "bank_index", "settlement_id", "true_settlement", "line_kind")


def truth_missing(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Lines with candidates none of which is the true settlement."""
    own = truth.where("settlement_id IS NOT NULL").select("entity", "bank_index", F.col("settlement_id").alias("true_settlement"))
    c = candidates.where("candidate IS NOT NULL").join(own, ["entity", "bank_index"])
    return c.groupBy("entity", "bank_index").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("row_ids") == F.col("true_settlement")).alias("n_true")).where("n_true = 0").drop("n_true")


def match_metrics(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision and recall in basis points; an empty denominator counts as full."""
    c = claims.select("entity", "bank_index", "settlement_id", F.lit(1).alias("claimed"))
    t = truth.where("settlement_id IS NOT NULL").select("entity", "bank_index", "settlement_id", F.lit(1).alias("real"))
    n = c.join(t, ["entity", "bank_index", "settlement_id"], "full").agg(
        F.count_if(F.expr("claimed = 1 AND real = 1")).alias("tp"), F.count_if(F.expr("claimed = 1 AND real IS NULL")).alias("fp"), F.count_if(F.expr("claimed IS NULL")).alias("fn"))
    share = lambda a, b: F.when(a + b == 0, 10_000).otherwise(F.call_function("div", a * 10_000, F.greatest(a + b, F.lit(1))))
    return n.withColumns({"precision_bp": share(F.col("tp"), F.col("fp")).cast("long"), "recall_bp": share(F.col("tp"), F.col("fn")).cast("long")})


def abstentions(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """Settlement lines by what became of them: verified, abstained or contradicted."""
    own = truth.where("settlement_id IS NOT NULL").select("entity", "bank_index")
    state = F.when(F.col("kind") == "verified", "verified").when(F.col("kind") == "discrepancy", "contradicted").otherwise("abstained")
    return own.join(outcomes.select("entity", "bank_index", "kind"), ["entity", "bank_index"], "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_lines"))


def violations(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """Contract breaches: an unknown kind, a verified line without a settlement, a settlement verified twice, a line twice."""
    breach = lambda df, name: df.select("entity", F.lit(name).alias("invariant"))
    known = F.col("kind").isin("verified", "discrepancy", "reconstructed", "ambiguous", "unresolved")
    verified = outcomes.where("kind = 'verified'")
    twice = lambda df, *keys: df.groupBy("entity", *keys).count().where("count > 1")
    return (
        breach(outcomes.where(~F.coalesce(known, F.lit(False))), "unknown_kind")
        .unionByName(breach(verified.where("settlement_id IS NULL"), "verified_without_settlement"))
        .unionByName(breach(twice(verified, "settlement_id"), "settlement_verified_twice"))
        .unionByName(breach(twice(outcomes, "bank_index"), "line_decided_twice"))
        .unionByName(breach(verified.join(rows, ["entity", "settlement_id"], "left_anti"), "verified_unknown_settlement"))
    )


def require(found: DataFrame) -> None:
    """Raises if there are violations."""
    bad = found.groupBy("invariant").count().collect()  # a row per invariant at most
    if bad:
        raise ValueError(", ".join(f"{r['invariant']}: {r['count']}" for r in bad))


#: Which party stands behind a source.
PARTIES = {"settlement_report": "psp", "ledger": "psp", "bank": "bank", "resolver": "resolver"}


def evidence(outcomes: DataFrame) -> DataFrame:
    """entity, bank_index, source, party of what a verified line rests on: the statement, the ledger and, in tier A, the report."""
    sources = F.when(F.col("tier") == "A", F.array(F.lit("bank"), F.lit("ledger"), F.lit("settlement_report"))).otherwise(F.array(F.lit("bank"), F.lit("ledger"), F.lit("resolver")))
    party = F.create_map(*(F.lit(x) for kv in PARTIES.items() for x in kv))
    return outcomes.where("kind = 'verified'").select("entity", "bank_index", F.explode(sources).alias("source")).withColumn("party", F.element_at(party, F.col("source")))


def independence(found: DataFrame) -> DataFrame:
    """Parties besides the resolver that support each line; two make it independent."""
    n = F.count_distinct(F.when(F.col("party") != "resolver", F.col("party")))
    return found.groupBy("entity", "bank_index").agg(n.alias("n_parties"), F.count(F.lit(1)).alias("n_evidence")).withColumn("independent", F.col("n_parties") >= 2)


def unwarranted(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """Assigned rows whose line has no evidence."""
    return assigned.join(found.select("entity", "bank_index").distinct(), ["entity", "bank_index"], "left_anti")


def premise_sharing(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the first-ranked candidate is the truth, and how often chance would have it, in millionths."""
    k = ranked.groupBy("entity", "bank_index").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("rank") == 1, F.col("row_ids"))).alias("first"))
    t = k.where("k > 1").join(truth.where("settlement_id IS NOT NULL").select("entity", "bank_index", "settlement_id"), ["entity", "bank_index"])
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == F.col("settlement_id")).alias("hits"), F.coalesce(F.sum(F.call_function("div", F.lit(1_000_000).cast("long"), F.col("k"))), F.lit(0)).alias("chance_millionths"))


def composition_difference(claimed: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows that a claim has too many and those that it lacks: entity, settlement_id, row_id, side."""
    key = ["entity", "settlement_id", "row_id"]
    extra = claimed.select(*key).distinct().join(truth, key, "left_anti").withColumn("side", F.lit("extra"))
    return extra.unionByName(truth.select(*key).distinct().join(claimed, key, "left_anti").withColumn("side", F.lit("missing")))


def reconstructible_abstentions(outcomes: DataFrame, closures: DataFrame, attested: DataFrame) -> DataFrame:
    """Lines without an attestation that have one closing set, proven by a complete search, and are not answered."""
    unique = closures.groupBy("entity", "bank_index").agg(F.count("candidate").alias("n"), F.every("complete").alias("complete")).where("n = 1 AND complete")
    own = unique.join(attested.select("entity", "bank_index"), ["entity", "bank_index"], "left_anti").select("entity", "bank_index")
    said = own.join(outcomes.select("entity", "bank_index", "kind"), ["entity", "bank_index"], "left")
    return said.where("kind IS NULL OR kind IN ('unresolved', 'ambiguous', 'open')")


def pair_metrics(flagged: DataFrame, truth: DataFrame, key: list[str], by: str) -> DataFrame:
    """True and false positives and misses of flagged keys by ``by``; precision and recall in basis points, none where undefined."""
    side = lambda df, value: df.select(*key, F.lit(value).alias("flagged"), F.lit(not value).alias("true"))
    return marked_metrics(side(flagged, True).unionByName(side(truth, False)), key, by)


def marked_metrics(marks: DataFrame, key: list[str], by: str) -> DataFrame:
    """``pair_metrics`` of one table whose columns ``flagged`` and ``true`` tell what a row says of its key; a key with a null meets no other."""
    both = marks.groupBy(*key).agg(F.max("flagged").alias("f"), F.max("true").alias("t"))
    both = both.withColumn("met", F.expr(" AND ".join(["f", "t", *(f"`{k}` IS NOT NULL" for k in key)])))
    n = both.groupBy(by).agg(F.count_if("met").alias("tp"), F.count_if(F.expr("f AND NOT met")).alias("fp"), F.count_if(F.expr("t AND NOT met")).alias("fn"))
    share = lambda d: F.when(d > 0, F.call_function("div", F.col("tp") * 10_000, F.greatest(d, F.lit(1))))
    return n.withColumns({"precision_bp": share(F.col("tp") + F.col("fp")), "recall_bp": share(F.col("tp") + F.col("fn"))})


def unique_closures_scored(closures: DataFrame, truth: DataFrame) -> DataFrame:
    """Lines with just one closing set: whether it is the true settlement."""
    one = closures.groupBy("entity", "bank_index").agg(F.count("candidate").alias("n"), F.min("row_ids").alias("row_ids")).where("n = 1")
    t = one.join(truth.select("entity", "bank_index", "settlement_id"), ["entity", "bank_index"], "left")
    right = F.coalesce(F.col("row_ids") == F.col("settlement_id"), F.lit(False))
    return t.groupBy(right.alias("right")).agg(F.count(F.lit(1)).alias("n"))


def claims_scored(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Claims by what they are: right, wrong, or unwarranted because the line is nobody's settlement; and lines left out."""
    t = truth.select("entity", "bank_index", F.col("settlement_id").alias("true_settlement"), "line_kind")
    x = claims.select("entity", "bank_index", "settlement_id").join(t, ["entity", "bank_index"], "full")
    what = (
        F.when(F.col("settlement_id").isNull() & (F.col("line_kind") == "settlement"), "missed").when(F.col("settlement_id").isNull(), "rightly_left")
        .when(F.coalesce(F.col("line_kind") != "settlement", F.lit(True)), "unwarranted").when(F.col("settlement_id") == F.col("true_settlement"), "right").otherwise("wrong"))
    return x.groupBy(what.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def reconstructions_scored(decided: DataFrame, named: DataFrame, rows: DataFrame, truth: DataFrame, attested: DataFrame) -> DataFrame:
    """What the cascade's third stage claims, against the answer key: (measure, n).

    Determinate lines of ours hold just their settlement's rows (right), or not (wrong); those of others are adopted.
    Rows are misplaced where a line holds what isn't its own. Without warrant are determinate lines that nobody attests
    (``attested``: entity, settlement_id), those that differ from what is attested, and ambiguous ones with rows assigned.
    """
    line = ["entity", "bank_index"]
    t = truth.select(*line, F.col("settlement_id").alias("own"), (F.col("line_kind") == "settlement").alias("ours"))
    known = attested.select("entity", F.col("settlement_id").alias("own"), F.lit(True).alias("attested")).distinct()
    x = decided.select(*line, "verdict").join(t, line, "left").join(known, ["entity", "own"], "left")
    sure = x.where("verdict = 'determinate'")
    actual = sure.where("ours").join(rows.where("settlement_id IS NOT NULL").select("entity", F.col("settlement_id").alias("own"), "row_id"), ["entity", "own"]).select(*line, "row_id", F.lit(1).alias("there"))
    claimed = named.join(sure.select(*line), line, "left_semi").select(*line, "row_id", F.lit(1).alias("claimed"))
    both = claimed.join(actual, [*line, "row_id"], "full").groupBy(*line).agg(F.count_if(F.col("there").isNull()).alias("extra"), F.count_if(F.col("claimed").isNull()).alias("missing"))
    certain = named.where("certain").select(*line).distinct().withColumn("assigned", F.lit(True))
    x = x.join(both, line, "left").join(certain, line, "left").na.fill(0, ["extra", "missing"])
    ours, differs, determinate = F.coalesce("ours", F.lit(False)), (F.col("extra") + F.col("missing")) > 0, F.col("verdict") == "determinate"
    no_warrant = determinate & (~F.coalesce("attested", F.lit(False)) | differs | ~ours) | (F.col("verdict") == "ambiguous") & F.coalesce("assigned", F.lit(False))
    counts = {"determinate": determinate, "ambiguous": F.col("verdict") == "ambiguous", "unresolved": F.col("verdict") == "unresolved", "right": determinate & ours & ~differs, "wrong": determinate & ours & differs,
              "foreign_adopted": determinate & ~ours, "without_warrant": no_warrant}
    one = x.agg(*(F.count_if(c).alias(k) for k, c in counts.items()), F.coalesce(F.sum(F.when(determinate, F.col("extra"))), F.lit(0)).alias("rows_misplaced"))
    names = [*counts, "rows_misplaced"]
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in names))))


def contract_breaches(outcomes: DataFrame, found: DataFrame, assigned: DataFrame, composed: DataFrame, dispositions: DataFrame, candidates: DataFrame, rivals: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every breach of the outcome contract: (invariant, entity, item), empty where all holds.

    ``outcomes``: entity, bank_index, tier, kind, reason, settlement_id; ``found``: evidence with source and
    party; ``assigned``: entity, bank_index, row_id; ``composed``: entity, bank_index, credit_ids, debit_ids;
    ``dispositions``: entity, row_id, proven, reason, caused_by, provable; ``candidates``: entity, bank_index, n, complete;
    ``rivals``: entity, bank_index, rivals; ``flagged``: entity, row_id, ground.
    """
    line, row = F.concat(F.lit("bank["), "bank_index", F.lit("]")), F.col("row_id")
    key, row_key, no = ["entity", "bank_index"], ["entity", "row_id"], F.lit(0)

    def breached(df, item, checks):  # all checks of a table in one pass
        return df.select("entity", item.alias("item"), F.explode(F.array_compact(F.array(*(F.when(F.expr(c) if isinstance(c, str) else c, name) for name, c in checks.items())))).alias("invariant")).select("invariant", "entity", "item")

    per_line = found.groupBy(*key).agg(
        F.count_if(F.col("source") == "ledger").alias("composition"), F.count_if(F.col("source") == "bank").alias("consequence"), F.count_distinct(F.when(F.col("party") != "resolver", F.col("party"))).alias("parties"))
    listed = outcomes.where("kind IN ('ambiguous', 'reconstructed')").join(candidates, key, "left")
    # assigned rows and dispositions meet once
    one, both = F.lit(1), F.when(F.expr("proven IS NOT NULL AND reason IS NOT NULL"), 1).otherwise(0)
    per_row = assigned.select(*row_key, "bank_index", one.alias("assigned"), no.alias("disposed"), no.alias("both")).unionByName(
        dispositions.select(*row_key, F.lit(None).cast(assigned.schema["bank_index"].dataType).alias("bank_index"), no.alias("assigned"), one.alias("disposed"), both.alias("both")))
    per_row = per_row.groupBy(*row_key).agg(F.count_distinct("bank_index").alias("lines"), F.sum("assigned").alias("assigned"), F.sum("disposed").alias("disposed"), F.sum("both").alias("both"))
    placed = (F.col("assigned") > 0) & (F.col("disposed") > 0) & F.col("entity").isNotNull() & row.isNotNull()
    open_ = dispositions.where("reason IS NOT NULL").select(*row_key, F.lit(True).alias("open")).distinct()
    return reduce(DataFrame.unionByName, [
        breached(found, line, {
            "evidence names a source": "source IS NULL OR source = ''", "an attestation is the processor's": "source = 'settlement_report' AND party <> 'psp'",
            "a bank reference is the bank's": "source = 'bank' AND party <> 'bank'"}),
        breached(outcomes.join(per_line, key, "left"), line, {
            "a warrant has evidence": "kind = 'verified' AND composition IS NULL", "verified names a composition": "kind = 'verified' AND coalesce(composition, 0) = 0",
            "verified confirms a consequence": "kind = 'verified' AND coalesce(consequence, 0) = 0", "verified has two parties": "kind = 'verified' AND coalesce(parties, 0) < 2",
            "verified carries no contradiction": "kind = 'verified' AND reason IS NOT NULL", "a discrepancy says what contradicts": "kind = 'discrepancy' AND reason IS NULL",
            "reconstructed has fewer than two parties": "kind = 'reconstructed' AND parties >= 2"}),
        breached(outcomes.where("kind = 'verified'").join(rivals, key, "left"), line, {"verified counts its rivals": "coalesce(rivals, 0) < 1"}),
        breached(composed, line, {
            "a row is on one side of a composition": F.size(F.array_intersect("credit_ids", "debit_ids")) > 0,
            "a composition is sorted": (F.col("credit_ids") != F.array_sort("credit_ids")) | (F.col("debit_ids") != F.array_sort("debit_ids"))}),
        breached(listed, line, {"ambiguous has two candidates": "kind = 'ambiguous' AND coalesce(n, 0) < 2", "reconstructed is unique and complete": "kind = 'reconstructed' AND (coalesce(n, 0) <> 1 OR NOT complete)"}),
        breached(outcomes.groupBy(*key).count(), line, {"a line has one outcome": "count > 1"}),
        breached(per_row, row, {"a row settles once": "lines > 1", "a row has one disposition": "disposed > 1 OR both > 0"}),
        breached(per_row.where(placed).withColumn("each", F.explode(F.array_repeat(F.lit(0), F.col("disposed").cast("int")))), row, {"an assigned row has no disposition": F.lit(True)}),
        breached(dispositions, row, {
            "a cause and its reason stand together": "(reason = 'upstream_unresolved') <> (caused_by IS NOT NULL)", "only timing is provable": "provable AND reason <> 'timing_difference'"}),
        breached(flagged.join(open_, row_key, "left"), row, {"a tax flag is on an open break": "open IS NULL", "a tax flag has its ground": "ground IS NULL"}),
    ])
