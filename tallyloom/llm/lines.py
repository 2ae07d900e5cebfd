"""Line dedup by ranges of hashes, in DataFrame functions only.

Every text is split at line feeds. A line's key is the line without white space at its ends and with A-Z in lower
case; keys of at least ``min_chars`` code points are hashed to 128 bits. The lines (hash, document, row, place; no
text) go to a stored table, are range-partitioned by hash and sorted by document and place, and a window streams each
key's run: the first document of it is the holder, and if ``min_docs`` documents have the key all its other lines go.
Documents get their keep bitmap as runs of kept lines (start, length), not their text.

Hot keys: lines are counted by ``COARSE`` buckets of their hash, and keys within buckets that hold more than
1 / ``HOT_KEYS`` of all lines are counted by themselves, map side first. So at most ``HOT_KEYS`` keys are hot; their
holders are broadcast and decide about their lines where these are, and no task meets more than that share of one key.

Defined cases: a null text is one empty line; documents are told apart by doc_id, so rows that share one count once
and hold a key together, and null ids are one document that ranks below all others; a row's bitmap goes by its id and
text, so repeated rows have equal bitmaps; a key stays wherever its holder has it, however often; a document's bitmap
is one value, as its text is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, stored

MIN_CHARS, MIN_DOCS = 40, 5
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hot keys at most, buckets of hashes that are counted to find them, and lines of a key that are never too many.
HOT_KEYS, COARSE, FEW_LINES = 1 << 16, 1 << 20, 1000
#: Characters beside ASCII of which no form in lower case differs.
CASELESS = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Z}]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is: ``lower`` where it does the same, which is far faster."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(CASELESS))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and ``row``, the hash that tells rows of one doc_id apart."""
    own = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return own.withColumn("row", F.xxhash64("doc_id", "text"))


def long_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, row, pos of the lines whose keys have ``min_chars`` code points."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return keys.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc_id", "row", "pos")


def hot_keys(lines: DataFrame) -> DataFrame:
    """h1, h2, holder, n_docs of the keys that hold more than 1 / ``HOT_KEYS`` of the lines: fewer than that many rows."""
    least = max(FEW_LINES, lines.count() // HOT_KEYS)
    bucket = F.pmod("h1", F.lit(COARSE)).alias("bucket")
    counts = lines.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("bucket")
    near = lines.select("*", bucket).join(F.broadcast(counts), "bucket", "left_semi")  # fewer than HOT_KEYS buckets
    of_key = near.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"))
    return of_key.where(F.col("n") > least).drop("n")


def dropped_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row, pos of the lines that go."""
    lines = stored(long_lines(rows, min_chars), "line-hashes")
    hot = stored(hot_keys(lines), "hot-lines")
    decided = lines.join(F.broadcast(hot), ["h1", "h2"]).where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("holder")))
    rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.desc("doc_id"), "pos")
    ranged = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    another = (F.row_number().over(order) == 1) | ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    runs = ranged.withColumns({"another": another.cast("int"), "holder": F.first("doc_id").over(order)})
    runs = runs.withColumn("n_docs", F.sum("another").over(key))
    gone = runs.where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("holder")))
    return decided.select("doc_id", "row", "pos").unionByName(gone.select("doc_id", "row", "pos"))


def kept_runs(gone: Column, n_lines: Column) -> Column:
    """Runs (start, length) of the lines that aren't among the sorted places ``gone``."""
    starts = F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i - 1) != x - 1, F.lit(True)))
    after = F.concat(F.array(F.lit(0)), F.transform(F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i + 1) != x + 1, F.lit(True))), lambda x: x + 1))
    ends = F.concat(starts, F.array(n_lines))
    runs = F.zip_with(after, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and ``keep``, the runs of kept lines, of each row; also its text if asked for."""
    rows = rows_of(docs, id_col, text_col)
    gone = dropped_lines(rows, min_chars, min_docs).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row"), "gone")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")
    own = rows.select("doc_id", "row", n_lines, *["text"] * with_text)
    both = own.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length")))
    return both.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), whole).otherwise(kept_runs(F.col("gone"), F.col("n_lines"))).alias("keep"), *["text"] * with_text)


def applied(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that the bitmap keeps, joined by line feeds."""
    lines = F.split(text, "\n")
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep and the kept text of each row; a text without repeats isn't cut and joined."""
    out = keep_bitmaps(docs, min_chars, min_docs, with_text=True)
    return out.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(applied(F.col("text"), F.col("keep"))))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the long lines that five documents share, but for the last document's."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
