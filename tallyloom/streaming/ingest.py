"""Incremental ingest: each payload once by its digest, bad ones aside, and break states across runs."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accepted_and_quarantined(batch: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Payloads once by digest, split by a validity condition."""
    once = batch.withColumn("sha256", F.sha2("payload", 256)).dropDuplicates(["sha256"])
    ok = F.coalesce(valid, F.lit(False))
    return once.where(ok), once.where(~ok)


#: Where a query's state lies: on disk, so that it may outgrow memory.
PROVIDER, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession):
    """Queries that are started here keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def ingest(source: DataFrame, accept: str, quarantine: str, checkpoint: str, valid, dead: str | None = None) -> None:
    """Runs a stream of (name, payload) to its end: digests that were there before are skipped, whatever their name.

    The checkpoint's state knows the digests, so a batch reads none of what was accepted; a new checkpoint beside an old
    table would take its payloads twice and raises. With ``dead`` the stream also has ``error``: a name that couldn't be fetched
    goes there once, with its error, and is taken when it comes again with a payload.
    """
    spark = source.sparkSession
    if ("error" in source.columns) != (dead is not None):
        raise ValueError("a stream with errors needs a folder of dead letters, and the reverse")
    if exists(spark, accept) and not exists(spark, checkpoint):
        raise ValueError(f"{accept} belongs to another checkpoint")
    failed = F.col("error").isNotNull() if dead else F.lit(False)
    digest = F.sha2("payload", 256)
    once = F.when(failed, F.concat(F.lit("dead "), F.coalesce("name", F.lit("")))).otherwise(digest)
    fresh = source.withColumn("sha256", F.when(~failed, digest)).withColumn("__once", once).dropDuplicates(["__once"]).drop("__once")
    ok = F.coalesce(valid, F.lit(False))
    parts = [(~failed & ok, accept), (~failed & ~ok, quarantine)] + ([(failed, dead)] if dead else [])

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # each part reads it
        for is_part, path in parts:
            part = batch.where(is_part)
            part = part.select("name", "error") if path == dead else part.drop("error")
            # a batch that runs again replaces its own folder
            part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    with rocks_db(spark):
        fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fetched(listing: DataFrame, fetch: Callable[[str], str], attempts: int = 5, base: float = 0.5) -> DataFrame:
    """name, payload, error of a stream or table of (name, key): each key is fetched where its row is, with retries.

    What still fails with an ``OSError`` has no payload and says why; any other failure ends the job.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, key in zip(part["name"], part["key"], strict=True):  # one payload in memory at a time
                payload, error = None, None
                try:
                    payload = with_retries(lambda: fetch(key), attempts, base)  # noqa: B023 - called at once
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"name": [name], "payload": [payload], "error": [error]})

    return listing.select("name", "key").mapInPandas(run, "name string, payload string, error string")


def open_dead_letters(dead: DataFrame, accepted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Dead letters whose name has come with a payload in no batch since: what is left to fetch again."""
    came = accepted.select("name").unionByName(quarantined.select("name"))
    return dead.select("name", "error").join(came, "name", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and len(fs.listStatus(target)) > 0


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the whole text files that arrive under a path."""
    return spark.readStream.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("payload"))


def with_retries(call: Callable, attempts: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """``call()`` again after growing waits; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n + 1 == attempts:
                raise
            sleep(base * 2**n * (1 + 0.25 * random.random()))  # noqa: S311


def break_states(sightings: DataFrame) -> DataFrame:
    """A stream of (row_id, seq, open) as state changes: opened, closed, reopened."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (was,) = state.get if state.exists else ("never",)
        out = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for seq, is_open in zip(rows.seq, rows.open, strict=True):
            now = "open" if is_open else "closed"
            if was != now and not (was == "never" and now == "closed"):
                out.append((key[0], int(seq), {"never": "opened", "closed": "reopened"}.get(was, "closed") if is_open else "closed"))
                was = now
        state.update((was,))
        yield pd.DataFrame(out, columns=["row_id", "seq", "change"])

    return sightings.groupBy("row_id").applyInPandasWithState(change, "row_id string, seq long, change string", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of a stream of (ts, event_type, value) by window; later than ``late`` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
