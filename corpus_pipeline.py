"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is one of the operators in ``tallyloom.llm`` applied to all that the stage before kept. Its
result is written as Parquet in the folder that the cluster shares and read again, so a lost executor
costs the tasks of one stage.

Defined cases: a null text, or one without a letter, is in no language and goes in the first stage;
texts that share an id, or have none, are documents of their own in every stage, and repeated rows are
copies, of which one stays; a text of nothing but repeats goes; very long texts are cut only when packed;
an empty table gives no rows; other columns, whatever their names, stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, langid, packing, simhash, substring
from tallyloom.llm.common import free_name, id_and_text, stored


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the labelled documents; what is in none of the languages goes."""
    return langid.in_a_language(docs, langid.learn(docs.select("doc_id", "text", "lang")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of each class the document with the smallest doc_id stays.

    Rows are told apart by id and text, so texts that share an id, or have none, are judged each for itself.
    Of rows with one id and text that with the smallest hash of all columns stays; null ids rank last.
    """
    key, row = free_name(docs, "__key"), free_name(docs, "__row")
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "text"), row: F.xxhash64(*docs.columns)})
    of = simhash.near_duplicates(keyed, id_col=key).distinct()
    first = keyed.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    # both sides have a row for each key
    ranked = first.join(of.withColumnsRenamed({"doc_id": key}), key).select("component_id", F.struct("first.*", key).alias("first"))
    kept = ranked.groupBy("component_id").agg(F.min("first").alias("first")).select(f"first.{key}", f"first.{row}")
    return keyed.join(kept, [key, row], "left_semi").dropDuplicates([key]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut but for their earliest occurrence; a document of nothing else goes."""
    cut = substring.without_repeats(docs)
    return cut.where(F.col("text").isNull() | F.col("text").rlike(r"\S"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(id_and_text(docs), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", in_a_language),
    ("near_duplicates", one_of_each_class),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the fingerprints nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None
