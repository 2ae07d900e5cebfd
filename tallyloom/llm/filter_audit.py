"""Filter interaction audit by windows over a long form.

Each document gets a mask with a bit for each filter that it fails. Documents are summed into cells (part, mask) with
their counts, and those of good and toxic ones: at most 32 cells a part, whatever the input. The cells are unpivoted
against the steps of all 120 orders; a running bit-or over an order's earlier steps says which filters have taken the
cell's documents before; conditional sums give the figures of a step, and a window over all steps of a filter the
total of what it removes.

Filters: A under 50 words; B under 65 % distinct words; C over 5 % of A-Z; D any of ``#$%&*|``; E a text that a
smaller doc_id has as well, by 128 bits of hash, a null text being empty.

Defined cases: a null source is the part of the empty string; a row with a null id is never the earlier or the later
of two equal texts, and has no labels; rows that share an id are documents of their own, none earlier than the other;
a document is good or toxic if any label of its id says so; a document without words fails A and no share; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, JUNK = 50, 65, 5, r"[#$%&*|]"
SPACES, SPACE_RUNS = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, part, mask of A to D, and the 128 bits h1, h2 of the text, of each row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    words = F.when(bare != "", F.split(bare, SPACE_RUNS)).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("words", words)
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [
        n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > UPPER_PERCENT * F.length("text"), F.rlike("text", F.lit(JUNK)),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return own.select("doc_id", "part", mask.alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def cells(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just those filters."""
    known = stored(facts(docs, **columns), "filter-facts")
    first = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = stored(first, "first-of-equal")  # read again it has an exchange of its own, so that Spark can split a hot text's rows
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    judged = known.join(first, ["h1", "h2"], "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    own = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return judged.join(own, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def audited(of: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of each step, from cells."""
    long = of.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    long = long.withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    bit = F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(FILTERS), F.col("filter")) - 1)
    long = long.withColumns({"bit": bit, "fails": F.col("mask").bitwiseAND(bit)})
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    gone, late = (F.col("fails") != 0) & (F.col("earlier") == 0), (F.col("fails") != 0) & (F.col("earlier") != 0)
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", (F.col("fails") == 0) & (F.col("earlier") == 0)).alias("kept"), total("n", gone).alias("removed"), total("n", late).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.withColumn("shapley", shapley).drop("filter")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source, in every order."""
    return audited(cells(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
good AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, len(w) < 50 AS a, 100 * list_unique(w) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts JOIN firsts USING (t) LEFT JOIN good USING (doc_id)
), cells AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM docs GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
long AS (
  SELECT part, o, step, o[step] AS f, n, good, toxic, fails, contains(fails, o[step]) AS own,
         step > 1 AND regexp_matches(fails, '[' || substr(o, 1, greatest(step - 1, 1)) || ']') AS earlier
  FROM cells, steps
), figures AS (
  SELECT part, o AS filter_order, step, f, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM long GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM figures
"""
