"""Tables that cut a long plan: written once in the folder that the cluster shares, and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def _delete() -> None:
    """What this driver has written goes when its Python ends; readers of it have ended by then."""
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the JVM may be gone already
            continue


def place(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir`` that goes when the driver ends; a local session without one uses /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete)
    _written.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own; a table that this function returned is one already."""
    if getattr(df, "stored_by_kept", False):
        return df
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_by_kept = True
    return table
