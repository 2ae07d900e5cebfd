"""What the training-data operators share: tables in the shared folder, text columns and hashing."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets one under /tmp; a cluster is refused, because a
    machine-local folder there would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "file:///tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_drop_scratch)
    _scratch.append((spark, path))
    return path


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the JVM may be gone already
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage: a lost executor costs the tasks that it ran, not the steps before. A narrow
    table takes far less room so than in an RDD checkpoint, and later reads prune its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` and ``text``: other columns, whatever their names, can't clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to differ from all columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
