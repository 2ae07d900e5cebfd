"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``n_slots`` slots, whose number never changes. Bytes are summed per slot, and
a stored map says where each slot lives. Its table has a row (version, virtual_slot, shard) for each
slot that a version moved: version 1 names all slots, a rebalance or a new shard appends an edit, and
a slot's shard at a version is what the latest edit up to it says. So any version can be read again
and only the slots of an edit move. The map and the sums per slot have ``n_slots`` rows whatever the
input's size; they alone reach the driver.

Defined cases: a null text has no bytes and counts 8; null ids are ordinary rows; rows with the same id and
text are spread over the slots by a number that each gets once; a very long text is a row of its own size, so no shard can be fuller than the emptiest by more than that;
an empty table gives an empty result and an evenly dealt map; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, scratch_path, stored

N_SLOTS = 4096
ROW_BYTES = 8


def slotted(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record, as a stored table.

    The slot hashes id and text together, so that rows which share an id don't all land in one slot. Rows that share
    both are spread as well: each is numbered once, in a stored table, and its number goes into its hash.
    """
    t, same = F.coalesce("text", F.lit("")), ["doc_id", "text_crc32"]
    records = stored(id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(t) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ), "shard-rows")
    repeated = stored(records.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("of"), F.col("text_crc32").alias("crc")), "repeated-rows")
    both = records.join(repeated, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_crc32") == F.col("crc")), "left")
    hashed = F.when(F.col("crc").isNull(), F.xxhash64(*same)).otherwise(F.xxhash64(*same, "row"))
    return stored(both.select("doc_id", "size", "text_crc32", F.pmod(hashed, F.lit(n_slots)).cast("int").alias("virtual_slot")), "shard-records")


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most ``n_slots`` rows, summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def dealt(n_slots: int, n_shards: int) -> dict[int, int]:
    """The first map: slots dealt to shards in turn, before any record is known."""
    return {slot: slot % n_shards for slot in range(n_slots)}


def rebalanced(placed: Mapping[int, int], loads: Mapping[int, int], n_shards: int) -> dict[int, int]:
    """An edit of ``placed``: slots move from the fullest to the emptiest shard while that narrows the gap.

    ``n_shards`` may be larger than before; new shards start empty, so slots move into them first.
    """
    placed = dict(placed)
    total = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in placed.items():
        total[shard] += loads.get(slot, 0)
        held[shard].append(slot)
    while True:
        full, empty = max(range(n_shards), key=lambda s: (total[s], -s)), min(range(n_shards), key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        fits = [s for s in held[full] if 0 < loads.get(s, 0) < gap]
        if not fits:
            return placed
        slot = min(fits, key=lambda s: (abs(2 * loads[s] - gap), s))
        held[full].remove(slot)
        held[empty].append(slot)
        total[full] -= loads[slot]
        total[empty] += loads[slot]
        placed[slot] = empty


def grown(placed: Mapping[int, int], loads: Mapping[int, int], n_shards: int) -> dict[int, int]:
    """An edit that adds shard ``n_shards``: it takes slots from the fullest shards, none move elsewhere."""
    placed = dict(placed)
    total = [0] * (n_shards + 1)
    for slot, shard in placed.items():
        total[shard] += loads.get(slot, 0)
    share = sum(total) // (n_shards + 1)
    for slot in sorted(placed, key=lambda s: (-loads.get(s, 0), s)):
        load, shard = loads.get(slot, 0), placed[slot]
        if load and total[n_shards] + load <= share and total[shard] - load >= share * 0.98:
            total[shard] -= load
            total[n_shards] += load
            placed[slot] = n_shards
    return placed


def write_edit(spark: SparkSession, path: str, before: Mapping[int, int], after: Mapping[int, int], version: int) -> None:
    """Append the slots that moved from ``before`` to ``after`` to the map's table as ``version``."""
    moved = [(version, slot, shard) for slot, shard in sorted(after.items()) if before.get(slot) != shard]
    spark.createDataFrame(moved, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def map_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard of the map's latest version, or of ``version``."""
    edits = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is not None:
        edits = edits.where(F.col("version") <= version)
    return edits.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """The map on the driver: ``n_slots`` entries."""
    return {r.virtual_slot: r.shard for r in map_at(spark, path, version).collect()}


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with shard and ``slot``, the gapless place of the record in its shard from 0.

    Places are numbered within each virtual slot, in parallel, and shifted by the rows of the slots
    before it in the same shard: no task sees a whole shard.
    """
    counts = slot_loads(records)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(counts, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    return (
        records.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(starts), "virtual_slot")  # n_slots rows at most
        .withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))
        .drop("start", "place")
    )


def shard(docs: DataFrame, n_shards: int, map_path: str, n_slots: int = N_SLOTS, **columns: str) -> DataFrame:
    """Records with their shard and place, read from a new map's latest version at ``map_path``.

    Version 1 deals the slots out, version 2 is the edit that rebalances them by the records' bytes.
    """
    spark = docs.sparkSession
    records = slotted(docs, n_slots, **columns)
    write_edit(spark, map_path, {}, dealt(n_slots, n_shards), 1)
    rebalance(spark, map_path, records, n_shards)
    return assign(records, map_at(spark, map_path))


def _next(spark: SparkSession, map_path: str, records: DataFrame, change: Callable[[dict[int, int], dict[int, int]], dict[int, int]]) -> int:
    loads = {r.virtual_slot: r.bytes for r in slot_loads(records).collect()}
    version = spark.read.parquet(map_path).agg(F.max("version")).first()[0] + 1
    before = read_map(spark, map_path)
    write_edit(spark, map_path, before, change(before, loads), version)
    return version


def rebalance(spark: SparkSession, map_path: str, records: DataFrame, n_shards: int) -> int:
    """Append the edit that evens the shards' bytes out; the new version's number."""
    return _next(spark, map_path, records, lambda before, loads: rebalanced(before, loads, n_shards))


def add_shard(spark: SparkSession, map_path: str, records: DataFrame, n_shards: int) -> int:
    """Append the edit that gives shard ``n_shards`` its slots; the new version's number."""
    return _next(spark, map_path, records, lambda before, loads: grown(before, loads, n_shards))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24, scratch_path(spark, "shard-map"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
