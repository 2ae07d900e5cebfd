"""A directory of reconciliation files as typed DataFrames.

Columns are found by role, not by position: a role may have several spellings, and two of them in one
file are an error rather than a preference. Money is parsed to whole paise; a malformed amount raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money
from ..operators.storage import kept
from . import arrays

#: File names, and the spellings of each role of a bank statement.
LEDGER, BANK, REPORT, ORDERS, DISPUTES, TAX = "recon_combined.json", "bank_statement.csv", "settlement_report.csv", "erp_orders.csv", "disputes.json", "gstr2b.csv"
OPTIONAL = {REPORT, ORDERS, TAX}
BANK_ROLES = {"reference": ["bank_reference", "utr"], "value_date": ["value_date", "date"], "narration": ["narration"], "amount": ["amount"]}
ANSWER_KEY = "ground_truth.json"
LEDGER_ITEM = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("entity_id", "type")),
    *(T.StructField(n, T.LongType()) for n in ("debit", "credit", "amount")), T.StructField("currency", T.StringType()),
    *(T.StructField(n, T.LongType()) for n in ("fee", "tax")), *(T.StructField(n, T.BooleanType()) for n in ("on_hold", "settled")),
    *(T.StructField(n, T.LongType()) for n in ("created_at", "settled_at")),
    *(T.StructField(n, T.StringType()) for n in ("settlement_id", "posted_at", "credit_type", "description", "notes", "payment_id", "settlement_utr", "order_id", "order_receipt", "method", "card_network", "card_issuer", "card_type", "dispute_id", "source_tier", "source_ref"))])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def resolve_roles(columns: list[str], roles: dict[str, list[str]]) -> dict[str, str]:
    """Role to the column that has it; a missing role or two spellings of one raise."""
    found = {}
    for role, spellings in roles.items():
        own = [s for s in spellings if s in columns]
        if len(own) != 1:
            raise ValueError(f"{role}: {'no column' if not own else 'several columns'} among {', '.join(spellings)}")
        found[role] = own[0]
    return found


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Adds the position in the file from 0 to rows just read from it, whatever the splits that Spark reads it in.

    Rows are numbered within their split; splits, of which there are few, know how many rows stand before them.
    """
    split = F.struct("_metadata.file_path", "_metadata.file_block_start")
    rows = kept(df.select(*df.columns, split.alias("__split"), F.monotonically_increasing_id().alias("__m")), "file-rows")
    splits = rows.groupBy("__split").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))  # over splits
    starts = splits.select("__split", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = rows.join(F.broadcast(starts), "__split")
    return placed.withColumn(name, (F.col("__before") + F.col("__m") - F.col("__first")).cast("int")).select(*df.columns, name)


def refuse_answer_key(path: str) -> str:
    """``path``; the answer key of a benchmark is never an input."""
    if path.rstrip("/").endswith(ANSWER_KEY):
        raise ValueError("the answer key is not an input")
    return path


def in_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file holds a JSON object in each line, told by its first line that isn't blank."""
    import json

    first = spark.read.text(refuse_answer_key(path)).where(F.trim("value") != "").limit(1).collect()
    try:
        head = json.loads(first[0]["value"]) if first else None
    except ValueError:
        return False
    return isinstance(head, dict) and not isinstance(head.get("items"), list)


def bank_statement(spark: SparkSession, path: str) -> DataFrame:
    """bank_index, reference, value_date, narration, amount (paise); a statement without lines raises."""
    raw = spark.read.option("header", True).csv(refuse_answer_key(path))
    role = resolve_roles(raw.columns, BANK_ROLES)
    out = in_file_order(raw, "bank_index").select(
        "bank_index", F.coalesce(role["reference"], F.lit("")).alias("reference"), F.col(role["value_date"]).cast("date").alias("value_date"),
        F.coalesce(role["narration"], F.lit("")).alias("narration"), money.paise(F.col(role["amount"])).alias("amount"))
    if out.isEmpty():
        raise ValueError(f"{path} has no lines")
    return out


def envelope(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Items of a JSON file: one in each line, a bare array, or an object with ``items``; anything else raises.

    An array that is larger than a split is cut where its items end.
    """
    parts = arrays.array_items(spark, path) if arrays.is_large(spark, refuse_answer_key(path)) else None
    if parts is not None:
        return parts.select(F.from_json("item", item, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    if in_lines(spark, path):
        return spark.read.schema(item).option("mode", "FAILFAST").json(path)
    text = spark.read.option("wholetext", True).text(path)
    wrapped = T.StructType([T.StructField("items", T.ArrayType(item))])
    bare = F.ltrim("value").startswith("[")
    items = F.when(bare, F.from_json("value", T.ArrayType(item))).otherwise(F.from_json("value", wrapped)["items"])
    known = text.withColumn("x", F.when(items.isNull(), F.raise_error(F.lit(f"{path}: neither an array nor an object with items"))).otherwise(items))
    return known.select(F.inline("x"))


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; a key that occurs twice, or a null one, raises."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = (n > 1) | F.col(key).isNull()
    return df.withColumn("__b", F.when(bad, F.raise_error(F.concat(F.lit(f"{key} missing or repeated: "), F.coalesce(key, F.lit("null")))).cast("int"))).where("__b IS NULL").drop("__b")


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Ledger rows, and whether any row has the key ``settlement_id`` at all: an absent key isn't a null."""
    text = spark.read.text(refuse_answer_key(path))
    has = bool(text.where(F.col("value").contains('"settlement_id"')).limit(1).count())
    return envelope(spark, path, LEDGER_ITEM), has


def disputes(spark: SparkSession, path: str) -> DataFrame:
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("dispute_id", T.StringType()), T.StructField("phase", T.StringType()), T.StructField("status", T.StringType()), T.StructField("opened_at", T.LongType()), T.StructField("amount_deducted", T.LongType())])
    found = envelope(spark, path, item).withColumn("id", F.coalesce("id", "dispute_id")).drop("dispute_id")
    return unique(found, "id")


def settlement_report(spark: SparkSession, path: str) -> DataFrame:
    raw = in_file_order(spark.read.option("header", True).csv(refuse_answer_key(path)), "file_position")
    return unique(raw.withColumn("reported_amount", money.paise(F.col("reported_amount"))), "settlement_id")


def tax_invoices(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(refuse_answer_key(path))
    cents = {c: money.paise(F.col(c)) for c in ("taxable_value", "igst", "cgst", "sgst")}
    out = raw.withColumns(cents)
    return out.select(
        "gstin", "invoice_no", F.col("gstr1_filing_period").alias("filing_period"), "taxable_value", (F.col("igst") + F.col("cgst") + F.col("sgst")).alias("tax_total"),
        (F.coalesce("irn", F.lit("")) != "").alias("has_irn"), (F.col("supplier_gstr3b_filed") == "Y").alias("filed"), (F.col("itc_availability") == "Yes").alias("available"))


def orders(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(refuse_answer_key(path))
    return raw.select("order_id", "invoice_no", F.nullif("gstin", F.lit("")).alias("gstin"), money.paise(F.col("amount")).alias("amount"), F.col("invoice_date").cast("date").alias("invoice_date"))


def load(spark: SparkSession, directory: str, strict: bool = False) -> dict[str, DataFrame]:
    """All files of a directory by role; ``strict`` makes the optional ones mandatory. The answer key is refused by name."""
    refuse_answer_key(directory)
    readers = {LEDGER: lambda s, p: ledger(s, p)[0], BANK: bank_statement, REPORT: settlement_report, ORDERS: orders, DISPUTES: disputes, TAX: tax_invoices}
    out = {}
    for name, read in readers.items():
        path = f"{directory.rstrip('/')}/{name}"
        if exists(spark, path):
            out[name.split(".")[0]] = read(spark, path)
        elif strict or name not in OPTIONAL:
            raise FileNotFoundError(path)
    return out


def items(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a JSON file or JSON lines as text, one per row in order; a line that isn't an object raises."""
    parts = arrays.array_items(spark, path) if arrays.is_large(spark, refuse_answer_key(path)) else None
    if parts is not None:
        return parts.select("n", F.to_json(F.parse_json("item")).alias("item"))
    if in_lines(spark, path):
        lines = in_file_order(spark.read.text(path), "n").where(F.trim("value") != "").select("n", F.trim("value").alias("item"))
        return lines.withColumn("item", F.when(~F.col("item").startswith("{"), F.raise_error(F.concat(F.lit("not an object: "), "item"))).otherwise(F.col("item")))
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    whole = F.coalesce(F.from_json(F.when(F.col("v").startswith("["), F.col("v")), "array<variant>"), F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), "struct<items:array<variant>>")["items"])
    whole = F.transform(whole, lambda x: F.to_json(x))
    lines = F.filter(F.split("v", "\n"), lambda x: F.trim(x) != "")
    rows = text.select(F.posexplode(F.when(whole.isNotNull(), whole).otherwise(lines)).alias("n", "item"))
    bad = ~F.ltrim("item").startswith("{")
    return rows.withColumn("item", F.when(bad, F.raise_error(F.concat(F.lit("not an object: "), "item"))).otherwise(F.col("item")))


def merged_pages(pages: DataFrame) -> DataFrame:
    """Items of ordered pages (page, items, has_more): only the last page may say that there is no more."""
    end = F.broadcast(pages.agg(F.max("page").alias("__last")))  # one row
    pages = pages.crossJoin(end)
    bad = F.col("has_more") == (F.col("page") == F.col("__last"))
    checked = pages.withColumn("items", F.when(bad, F.raise_error(F.concat(F.lit("page out of order: "), F.col("page").cast("string")))).otherwise(F.col("items")))
    return checked.select("page", F.posexplode("items").alias("n", "item"))


def artefact_of(columns: set[str]) -> str | None:
    """Which file a set of columns or keys belongs to; none if that is ambiguous."""
    marks = {LEDGER: {"entity_id", "credit", "debit"}, REPORT: {"reported_reference", "reported_amount"}, ORDERS: {"order_id", "invoice_no"}, DISPUTES: {"phase", "opened_at"}, TAX: {"gstr1_filing_period"}}
    found = [name for name, own in marks.items() if own <= columns]
    found += [BANK] * (all(columns & set(s) for s in BANK_ROLES.values()))
    return found[0] if len(found) == 1 else None


def manifest_gaps(named: set[str]) -> tuple[set[str], set[str]]:
    """(missing, unknown) names of a manifest that must cover all six files."""
    every = {LEDGER, BANK, REPORT, ORDERS, DISPUTES, TAX}
    return every - named, named - every


def pulled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files under a path with their SHA-256: what a transport lists and fetches."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def replayed(spark: SparkSession, recording: str) -> DataFrame:
    """Files of a recorded transport: a JSON line for each with key, path and sha256; a file that is gone or differs raises."""
    records = spark.read.schema("key string, path string, sha256 string").json(recording)
    paths = [r["path"] for r in records.select("path").collect()]  # one for each recorded file
    there = pulled(spark, paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("sha256").alias("found"), "content")
    both = records.join(there, "path", "left")
    bad = F.col("found").isNull() | (F.col("found") != F.col("sha256"))
    return both.withColumn("key", F.when(bad, F.raise_error(F.concat(F.lit("not as recorded: "), "key"))).otherwise(F.col("key"))).select("key", "path", "length", "sha256", "content")


def write_exact(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A table as one CSV file whose bytes depend on its rows alone: fixed columns, fixed order, line feeds."""
    df.select(*columns).orderBy(*order).coalesce(1).write.option("header", True).option("lineSep", "\n").csv(path)
