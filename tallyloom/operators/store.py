"""Runs and their history: idempotent writes, break lifecycles, approvals and the queries on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, text


def run_id(input_digest: Column, code_digest: Column, cap: Column, budget: Column) -> Column:
    return text.digest(input_digest, code_digest, cap.cast("string"), budget.cast("string"))


def new_runs(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs that aren't stored yet, once each: writing a run twice changes nothing."""
    return runs.dropDuplicates(["run_id"]).join(stored.select("run_id"), "run_id", "left_anti")


def flattened(outcomes: DataFrame) -> DataFrame:
    """Outcomes as stored: scalar columns and the whole outcome as JSON."""
    return outcomes.select("entity", "bank_index", "kind", "reason", F.to_json(F.struct(*outcomes.columns)).alias("outcome"))


def row_history(states: DataFrame) -> DataFrame:
    """Changes of each row's state over its runs: (row_id, seq, state) to from, to and seq."""
    w = Window.partitionBy("row_id").orderBy("seq")
    return states.withColumn("before", F.lag("state").over(w)).where("before IS NULL OR before <> state").select("row_id", "seq", "before", F.col("state").alias("after"))


def break_spans(sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """Open, close and reopen of breaks: one row per span of consecutive runs of an entity in which a row was open.

    ``sightings``: entity, row_id, seq; ``runs``: entity, seq. closed_seq is null while open.
    """
    numbered = runs.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("seq")))
    last = runs.groupBy("entity").agg(F.max("seq").alias("last_seq"))
    following = numbered.withColumn("closed_seq", F.lead("seq").over(Window.partitionBy("entity").orderBy("seq"))).select("entity", "seq", "k", "closed_seq")
    s = sightings.join(following, ["entity", "seq"])
    s = s.withColumn("g", F.col("k") - F.row_number().over(Window.partitionBy("entity", "row_id").orderBy("k")))
    spans = s.groupBy("entity", "row_id", "g").agg(F.min("seq").alias("opened_seq"), F.max("seq").alias("last_seen_seq"), F.max_by("closed_seq", "seq").alias("closed_seq"))
    return spans.join(last, "entity").select("entity", "row_id", "opened_seq", "last_seen_seq", "closed_seq")


def merged_history(history: DataFrame, sightings: DataFrame, entity: int, seq: int) -> DataFrame:
    """History after one run of one entity: seen breaks stay or reopen, unseen ones of this entity close, new ones open."""
    seen = sightings.select("row_id", F.lit(True).alias("seen"))
    h = history.join(seen, "row_id", "full")
    own = F.coalesce(F.col("entity"), F.lit(entity)) == entity
    there = F.coalesce("seen", F.lit(False))
    return h.select(
        "row_id", F.coalesce("entity", F.lit(entity)).alias("entity"), F.coalesce("first_seq", F.lit(seq)).alias("first_seq"),
        F.when(there, seq).otherwise(F.col("last_seq")).alias("last_seq"),
        F.when(there, None).when(own & F.col("closed_seq").isNull(), seq).otherwise(F.col("closed_seq")).alias("closed_seq"))


def upsert_history(path: str, sightings: DataFrame, entity: int, seq: int, buckets: int = 64) -> list[int]:
    """Merges a run into the history stored at ``path`` and says which buckets it wrote anew.

    The table is partitioned by a bucket of the row id. Only buckets that hold a row which the run sees, or an open
    break of its entity, are read and merged; of these, those whose digest changes are overwritten by themselves. So a run
    costs what it touches, and merging it twice writes nothing. Buckets are a parameter of the table and stay as they
    are. One run is merged at a time; a job that ends early leaves each bucket whole, before or after, and is repeated.
    """
    from pyspark.errors import AnalysisException

    from .storage import kept

    spark = sightings.sparkSession
    bucket = F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int")
    schema = "row_id string, entity long, first_seq long, last_seq long, closed_seq long, bucket int"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the first run
        stored = spark.createDataFrame([], schema)
    seen = sightings.select("row_id").distinct().withColumn("bucket", bucket)
    asked = seen.select("bucket").unionByName(stored.where((F.col("entity") == entity) & F.col("closed_seq").isNull()).select("bucket")).distinct()
    asked = [r.bucket for r in asked.collect()]  # a parameter of the table bounds them
    before = stored.where(F.col("bucket").isin(asked))
    after = kept(merged_history(before.drop("bucket"), seen, entity, seq).withColumn("bucket", bucket), "merged-history")
    values = [c.split()[0] for c in schema.split(", ")]
    digest = lambda df, name: df.groupBy("bucket").agg(F.struct(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(*values), F.lit(1 << 31))), F.bit_xor(F.xxhash64(*values))).alias(name))
    both = digest(after, "new").join(digest(before.select(*values), "old"), "bucket", "left")
    changed = sorted(r.bucket for r in both.where(~F.col("new").eqNullSafe(F.col("old"))).collect())
    if changed:
        after.where(F.col("bucket").isin(changed)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return changed


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id string, entity long, first_seq long, last_seq long, closed_seq long, bucket int").parquet(path).drop("bucket")


def open_by_bucket(found: DataFrame) -> DataFrame:
    """Open breaks by age; all four buckets are there."""
    names = found.sparkSession.createDataFrame([(b,) for b in ("0-30", "31-60", "61-90", "90+")], "bucket string")
    n = found.where("reason IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("age_days").alias("oldest"))
    return F.broadcast(names).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "oldest")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The newest event of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def approval_states(events: DataFrame) -> DataFrame:
    """Requests with the first decision after them: a decided request stays decided."""
    made = events.where("action = 'create'").groupBy("request_id").agg(F.min("at").alias("created_at"))
    decided = events.where("action IN ('approved', 'rejected')")
    first = latest(decided.withColumn("neg", -F.col("at")), "request_id", "neg").select("request_id", F.col("action").alias("status"), F.col("at").alias("resolved_at"))
    return made.join(first, "request_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def valid_resolutions(resolutions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Human choices that are one of the line's candidates."""
    return resolutions.join(candidates.select("entity", "bank_index", F.col("row_ids").alias("choice")), ["entity", "bank_index", "choice"], "left_semi")


#: The grid's filter words and the kinds that they stand for.
FILTER_KINDS = {
    "unmatched": ["unresolved", "ambiguous", "discrepancy", "open"], "unresolved": ["unresolved", "ambiguous", "discrepancy", "open"], "open": ["unresolved", "ambiguous", "discrepancy", "open"],
    "verified": ["verified"], "matched": ["verified"], "ambiguous": ["ambiguous"], "discrepancy": ["discrepancy"], "discrepancies": ["discrepancy"],
}


def filtered_lines(lines: DataFrame, query: str, aged: DataFrame | None = None) -> DataFrame:
    """The grid's filter words: kinds, ``over N`` or ``> N`` rupees, and the rest as a part of reference or narration.

    All words must hold. ``aged`` (entity, bank_index) names the lines of a chosen age.
    """
    import re

    text_, out = query.lower(), lines
    if aged is not None:
        out = out.join(aged.select("entity", "bank_index").distinct(), ["entity", "bank_index"], "left_semi")
    if found := re.search(r"(?:over|>)\s*₹?\s*(\d[\d,]*)", text_):
        out = out.where(F.abs("amount") > int(found[1].replace(",", "")) * 100)
    words = text_.split()
    for word in [w for w in words if w in FILTER_KINDS]:
        out = out.where(F.col("kind").isin(FILTER_KINDS[word]))
    left = " ".join(w for w in words if w not in FILTER_KINDS and w not in ("over", "clear") and not re.fullmatch("[0-9,₹>]+", w))
    if left:
        where_ = [c for c in ("reference", "narration") if c in lines.columns]
        out = out.where(reduce(Column.__or__, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(left)) for c in where_)))
    return out


#: What a question may be made of: nodes of the parsed plan, and functions. Everything else is refused.
ALLOWED_NODES = frozenset("""Project Filter Aggregate Sort Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation UnresolvedInlineTable
    GlobalLimit LocalLimit Offset Distinct Union Intersect Except UnresolvedHaving WithWindowDefinition Generate""".split())
ALLOWED_FUNCTIONS = frozenset("""abs any_value array array_contains array_distinct array_join array_sort avg bool_and bool_or ceil ceiling char_length coalesce collect_list collect_set
    concat concat_ws contains count count_if current_date date date_add date_diff date_format date_sub date_trunc day dayofweek dense_rank div endswith every
    exists explode filter first first_value floor from_unixtime get_json_object greatest if ifnull in initcap instr isnotnull isnull lag last last_day last_value
    lead least left length like lower lpad ltrim max max_by median min min_by mod month months_between named_struct not nullif nvl nvl2 percent_rank percentile
    position power rank regexp_extract regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim sequence sign size some split sqrt
    startswith stddev struct substr substring sum to_date to_timestamp transform trim trunc try_cast try_divide upper variance when year""".split())


def safe_select(spark: SparkSession, sql: str) -> DataFrame:
    """Runs one SELECT over tables and views of the catalogue; anything else raises before it runs.

    The text is parsed by Spark, which takes one statement, and every node and function of the tree, subqueries
    included, must be on a list. A table must be known to the catalogue, so a path isn't one.
    """
    body = sql.strip()
    if not body[:6].lower() == "select":
        raise ValueError("only SELECT is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as error:
        raise ValueError("one SELECT statement is allowed") from error
    todo = [plan]
    items = lambda seq: [seq.apply(k) for k in range(seq.size())]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "UnresolvedRelation":
            parts = items(node.multipartIdentifier())
            if not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
                raise ValueError(f"no such table: {'.'.join(parts)}")
        if _is_kind(spark, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            if name not in ALLOWED_NODES:
                raise ValueError(f"{name} isn't allowed")
            todo += items(node.children()) + items(node.expressions())
            continue
        if name in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = items(node.nameParts()) if name == "UnresolvedFunction" else [node.name().funcName()]
            if len(parts) != 1 or parts[0].lower() not in ALLOWED_FUNCTIONS:
                raise ValueError(f"{'.'.join(parts)} isn't allowed")
        elif _is_kind(spark, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            todo.append(node.plan())
        todo += items(node.children())
    return spark.sql(body)


def _is_kind(spark: SparkSession, node, name: str) -> bool:
    return spark._jvm.java.lang.Class.forName(name, False, node.getClass().getClassLoader()).isInstance(node)


def escalations(found: DataFrame) -> DataFrame:
    """Open breaks that ask for something at their age, by reason and bucket, with owner and closing condition."""
    from .dispositions import ESCALATION, ROUTING

    spark = found.sparkSession
    asks = spark.createDataFrame(ESCALATION, "reason string, bucket string, action string")
    owners = spark.createDataFrame(ROUTING, "reason string, owner string, closes_when string")
    n = found.where("reason IS NOT NULL").groupBy("reason", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(asks), ["reason", "bucket"]).join(F.broadcast(owners), "reason")


def entity_status(outcomes: DataFrame) -> DataFrame:
    """not_started, certified, awaiting_approval or in_progress for each entity."""
    n = outcomes.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("kind = 'verified'")).alias("v"), F.count_if(F.expr("kind = 'discrepancy'")).alias("d"))
    return n.select("entity", F.when(F.col("v") == 0, "not_started").when(F.col("v") == F.col("n"), "certified").when(F.col("d") > 0, "awaiting_approval").otherwise("in_progress").alias("status"))


def age_of(created: Column, as_of: Column) -> Column:
    return calendar.age_bucket(F.greatest(F.lit(0), as_of - created))


def runs_in_order(runs: DataFrame) -> DataFrame:
    """Runs (dataset, run_id, started_at) of each dataset by their start, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("started_at", "run_id")).cast("long")
    return runs.withColumn("place", place)


def outcomes_of(outcomes: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The stored outcomes of the asked keys; a key without an outcome keeps its row."""
    return keys.select(*on).distinct().join(outcomes, on, "left")


def rebuilt(row_outcomes: DataFrame) -> DataFrame:
    """Breaks of a run as they were before their outcome was stored with each row: equal outcomes once, with their rows counted."""
    return row_outcomes.groupBy("entity", "outcome").agg(F.count(F.lit(1)).alias("n_rows"))


def line_summaries(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each line's kind, reason and amount with the sources that it rests on."""
    named = sources.groupBy("entity", "bank_index").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return outcomes.select("entity", "bank_index", "kind", "reason", "amount").join(named, ["entity", "bank_index"], "left").withColumn("sources", F.coalesce("sources", F.lit("")))


def carry_forward(found: DataFrame) -> DataFrame:
    """Timing breaks of each entity, split by whether the window proves that they can't have a credit yet."""
    own = found.where("reason = 'timing_difference'")
    return own.groupBy("entity").agg(F.count(F.lit(1)).alias("total"), F.count_if("provable").alias("provable"), F.count_if(~F.col("provable")).alias("not_provable"))


def case_facts(found: DataFrame, states: DataFrame) -> DataFrame:
    """Unexplained breaks with how many states their row had over the runs, and whether it differs between them."""
    n = states.groupBy("row_id").agg(F.count_distinct("state").alias("n_states"))
    own = found.where("reason = 'unexplained'").select("entity", "row_id", "age_days", "first_seen").join(n, "row_id", "left")
    return own.withColumn("n_states", F.coalesce("n_states", F.lit(0))).withColumn("differs", F.col("n_states") > 1)


#: The rule behind each ground of a tax credit at risk.
STATUTES = {"gstr2b_absent": "Sec 16(2)(aa), CGST Act", "gstr2b_no_irn": "Rule 48(5), CGST Rules", "gstr2b_37a_exposure": "Rule 37A, CGST Rules"}


def grounds_of_rows(found: DataFrame, rows: DataFrame, risk: DataFrame) -> DataFrame:
    """Open breaks that accrue tax in a month at risk: one row per ground, with its rule."""
    from . import tax

    own = rows.where(tax.accrues()).withColumn("month", calendar.month_of(calendar.local_day(F.col("settled_at")))).select("entity", "row_id", "month")
    rule = F.create_map(*(F.lit(x) for kv in STATUTES.items() for x in kv))
    open_ = found.where("reason IS NOT NULL").select("entity", "row_id", "age_days", "first_seen")
    return open_.join(own, ["entity", "row_id"]).join(risk, ["entity", "month"]).withColumn("statute", F.element_at(rule, F.col("ground")))


def encoded(outcomes: DataFrame, type_of: Column) -> DataFrame:
    """Outcomes as JSON that names its type, so that they can be read back without loss."""
    return outcomes.select(F.to_json(F.struct(type_of.alias("__type__"), *outcomes.columns), {"ignoreNullFields": "false"}).alias("outcome"))


def decoded(stored: DataFrame, schema: str) -> DataFrame:
    """The outcomes behind ``encoded``; a text that isn't of this form raises."""
    o = F.from_json("outcome", f"__type__ string, {schema}", {"mode": "FAILFAST"})
    return stored.select(o.alias("o")).select("o.*")


def write_run(outcomes: DataFrame, run: Column, path: str) -> None:
    """Append a run's outcomes to the store, in a folder of its own; a run that is there already is written once more to the same rows."""
    outcomes.withColumn("run_id", run).write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The outcomes of one stored run; only its folder is read."""
    return spark.read.parquet(path).where(F.col("run_id") == run).drop("run_id")


def sorted_by(df: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """A table by any of its columns, numbers as numbers and texts without case, nulls last."""
    text_ = df.schema[column].dataType.simpleString() == "string"
    key = F.lower(column) if text_ else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *([tie] if tie else []))
