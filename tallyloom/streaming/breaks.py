"""Break history as a stream: what opens, closes and reopens as runs complete, from state alone.

A run's sightings may come in any number of batches and wait in the state; the run's marker says that they are all there.
Only then is it known which rows the run no longer shows. ``follow`` merges a batch with tables of state; ``break_changes``
is the same as a stream of its own, whose state is by key. Either deals the rows of an entity out to buckets of row ids, so that
one entity with most of the rows is many keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import exists

CHANGES = "entity long, row_id string, seq long, change string, first_seq long, opened_seq long, last_seq long"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]


class Breaks(StatefulProcessor):
    """State of one bucket: the last complete run with rows known (first and latest opening, whether open), and sightings that wait.

    An open row was seen by the last complete run, so a run writes only the rows that it changes. What is known is one value,
    read and written once a batch: most buckets are a few rows of a small entity, and a call for each row would cost more than the row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "done long, waits boolean, rows array<struct<row_id: string, first: long, opened: long, open: boolean>>")
        self.waiting = handle.getListState("waiting", "seq long, row_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        entity = int(key[0])
        last, waits, known = self.known.get() or (None, False, [])
        known = {row_id: (first, opened, is_open) for row_id, first, opened, is_open in known}
        complete, seen, late, out = set(), {}, set(), []
        for row in rows:
            seq, row_id, marker = row["seq"], row["row_id"], row["marker"]
            if last is not None and seq <= last:
                late |= set() if marker else {(seq, row_id)}
            elif marker:
                complete.add(seq)
            else:
                seen.setdefault(seq, set()).add(row_id)
        until = max(complete, default=None)
        left = []  # sightings of runs that aren't complete
        if complete and waits:
            for seq, row_id in self.waiting.get():
                if seq <= until:
                    seen.setdefault(seq, set()).add(row_id)
                else:
                    left.append((seq, row_id))
        for seq in sorted({*seen, *complete}):
            if seq in complete:
                out += self._run(seq, last, seen.get(seq, set()), known)
                last = seq
            elif complete and seq < until:  # the marker of a later run came first
                late |= {(seq, r) for r in seen[seq]}
            else:
                left += [(seq, r) for r in seen[seq]]
        if complete and waits:
            self.waiting.put(left) if left else self.waiting.clear()
        elif left:
            self.waiting.appendList(left)
        if complete or left and not waits:
            self.known.update((last, bool(left) or waits and not complete, [(r, *x) for r, x in known.items()]))
        for change in out + [(r, seq, "late", None, None, None) for seq, r in sorted(late)]:
            yield Row(**dict(zip(NAMES, (entity, *change), strict=True)))

    @staticmethod
    def _run(seq: int, last: int | None, seen: set[str], known: dict) -> list[tuple]:
        out, new = [], seen - known.keys()
        for row_id, (first, opened, is_open) in known.items():
            if row_id in seen and not is_open:
                out.append((row_id, seq, "reopened", first, seq, seq))
                known[row_id] = (first, seq, True)
            elif row_id not in seen and is_open:
                out.append((row_id, seq, "closed", first, opened, last))
                known[row_id] = (first, opened, False)
        for row_id in sorted(new):
            out.append((row_id, seq, "opened", seq, seq, seq))
            known[row_id] = (seq, seq, True)
        return out

    def close(self) -> None:
        pass


def break_changes(sightings: DataFrame, buckets: int = 64) -> DataFrame:
    """A stream of (entity, seq, row_id), where a null row id says that the run is complete, as changes of breaks.

    A change is opened, closed or reopened, with the first run that ever saw the row, the run that opened this span and
    the last that saw it. Runs of an entity count in order of ``seq``: a marker completes its run and all before it, a
    repeated marker or sighting changes nothing, and a sighting of a run that is past is told as ``late``. Rows without
    entity or seq belong to no run and are left out. ``buckets`` belongs to the checkpoint and stays as it is. Each key is a call or two
    of a Python process a batch, so for very many entities ``follow`` is the faster one. Start it within ``ingest.rocks_db``.
    """
    mine = F.array(F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int"))
    every = F.array(*(F.lit(k) for k in range(buckets)))
    marker = F.col("row_id").isNull()
    dealt = sightings.where("entity IS NOT NULL AND seq IS NOT NULL").select(
        F.col("entity").cast("long").alias("entity"), F.col("seq").cast("long").alias("seq"), "row_id", marker.alias("marker"), F.explode(F.when(marker, every).otherwise(mine)).alias("bucket"))
    return dealt.groupBy("entity", "bucket").transformWithState(Breaks(), CHANGES, "Append", "None")


#: What ``follow`` keeps of an entity beside the columns of a change: the last complete run, sightings that wait, rows that are open or closed.
DONE, WAITS, OPEN, SHUT = "done", "waits", "open", "shut"


def merged(batch: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """Changes (part -1) and the state after them (part: the entity's bucket) of a batch of sightings and the state of its buckets.

    Columns and changes are those of ``break_changes``. A row meets its entity's runs (the last complete one and those that this batch
    completes) by one join, and what is known of it in one window of its own. An entity's runs go to ``buckets`` of its rows, so that one
    with most of the rows is as many keys.
    """
    fresh = batch.where("entity IS NOT NULL AND seq IS NOT NULL").select(F.col("entity").cast("long").alias("entity"), "row_id", F.col("seq").cast("long").alias("seq"))
    done = state.where(F.col("change") == DONE).select("entity", F.col("seq").alias("last"), F.lit(None).cast("long").alias("seq"))
    markers = fresh.where("row_id IS NULL").select("entity", F.lit(None).cast("long").alias("last"), "seq")
    heads = markers.unionByName(done).groupBy("entity").agg(F.max("last").alias("last"), F.collect_set("seq").alias("seqs"))
    new = F.sort_array(F.filter("seqs", lambda s: F.col("last").isNull() | (s > F.col("last"))))
    heads = heads.select("entity", "last", F.concat(F.when(F.col("last").isNull(), F.array().cast("array<long>")).otherwise(F.array("last")), new).alias("seqs"))
    none = F.lit(None).cast("long")
    rows = fresh.where("row_id IS NOT NULL").select("entity", "row_id", "seq", F.lit(WAITS).alias("kind"), none.alias("first"), none.alias("since")).unionByName(
        state.where(F.col("change") != DONE).select("entity", "row_id", "seq", F.col("change").alias("kind"), F.col("first_seq").alias("first"), F.col("opened_seq").alias("since")))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int"))
    rows = rows.join(heads.withColumn("deal", F.explode(F.array(*map(F.lit, range(buckets))))), ["entity", "deal"], "left")
    k = F.when(F.col("kind") == OPEN, 1).when((F.col("kind") == WAITS) & (F.col("last").isNull() | (F.col("seq") > F.col("last"))), F.nullif(F.array_position("seqs", F.col("seq")), F.lit(0)))
    seq = F.when(F.col("kind") == OPEN, F.col("last")).otherwise(F.col("seq"))
    rows = rows.select(
        "entity", "deal", "row_id", "kind", "first", "since", seq.alias("seq"), k.alias("k"), F.size("seqs").alias("n"), F.try_element_at("seqs", (k + 1).cast("int")).alias("then"),
        F.coalesce((F.col("kind") == WAITS) & k.isNull() & (F.col("seq") <= F.try_element_at("seqs", F.lit(-1))), F.lit(False)).alias("late"))
    order = Window.partitionBy("entity", "deal", "row_id").orderBy(F.asc_nulls_first("k"), F.asc_nulls_first("seq"))
    k = F.col("k")
    rows = rows.withColumns({"before": F.lag("k").over(order), "same": F.lag("seq").over(order), "after": F.lead("k").over(order), "is_last": F.lead(F.lit(1)).over(order).isNull()})
    starts = (F.col("kind") == WAITS) & k.isNotNull() & F.coalesce(F.col("before") < k - 1, F.lit(True))
    rows = rows.withColumn("start", F.when(starts, F.col("seq")))
    until = order.rowsBetween(Window.unboundedPreceding, 0)  # what is known comes first, spans in their order
    rows = rows.withColumns({"first": F.min(F.coalesce("first", "start")).over(until), "since": F.max(F.coalesce("start", "since")).over(until)})
    mine = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")

    def told(when, change, seq, first=none, opened=none, last=none, part=F.lit(-1)):
        return F.when(when, F.struct(seq.alias("seq"), change.alias("change"), first.alias("first_seq"), opened.alias("opened_seq"), last.alias("last_seq"), part.alias("part")))

    own, first, since = F.col("seq"), F.col("first"), F.col("since")
    again = k.isNull() & F.coalesce(F.col("same") == own, F.lit(False))
    waits = (F.col("kind") == WAITS) & k.isNull() & ~again
    made = F.array(
        told(F.col("start").isNotNull(), F.when(own == first, "opened").otherwise("reopened"), own, first, own, own),
        told((k < F.col("n")) & F.coalesce(F.col("after") > k + 1, F.lit(True)), F.lit("closed"), F.col("then"), first, since, own),
        told(waits & F.col("late"), F.lit("late"), own),
        told(waits & ~F.col("late"), F.lit(WAITS), own, part=mine),
        told(F.col("is_last") & first.isNotNull(), F.when(k == F.col("n"), OPEN).otherwise(SHUT), none, first, since, part=mine))
    last = heads.select("entity", F.lit(None).cast("string").alias("row_id"), F.element_at("seqs", -1).alias("seq"), F.lit(DONE).alias("change"), *(none.alias(c) for c in NAMES[4:]), mine.alias("part"))
    return rows.select("entity", "row_id", F.inline(made)).where("change IS NOT NULL").unionByName(last)


def follow(sightings: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Adds the changes that ``break_changes`` would tell of what has arrived to the table at ``path``, each once, restarts included.

    State lies in tables beside the checkpoint, by bucket of the entity: a batch reads and writes the buckets that it touches, without a call
    for each entity. A batch that runs again reads what it read before and replaces its own folders.
    """
    spark, state, hadoop = sightings.sparkSession, f"{checkpoint}/breaks", sightings.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(state)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        if exists(spark, path) or exists(spark, checkpoint):
            raise ValueError(f"{path} or {checkpoint} belongs to another stream or an earlier form of it")
        fs.mkdirs(at)

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = {r[0] for r in batch.where("entity IS NOT NULL AND seq IS NOT NULL").select(F.pmod(F.xxhash64(F.col("entity").cast("long")), F.lit(buckets)).cast("int")).distinct().collect()}
        versions: dict[int, list[int]] = {}
        for found in fs.globStatus(hadoop.Path(f"{state}/batch=*/part=*")) or []:
            n, part = (int(x.split("=")[1]) for x in found.getPath().toString().split("/")[-2:])
            if n < batch_id:
                versions.setdefault(part, []).append(n)
        of = lambda n, part: f"{state}/batch={n}/part={part}"
        known = [of(max(versions[part]), part) for part in sorted(touched & versions.keys())]
        before = batch.sparkSession.read.schema(CHANGES).parquet(*known) if known else batch.sparkSession.createDataFrame([], CHANGES)
        merged(batch, before, buckets).write.mode("overwrite").partitionBy("part").parquet(f"{state}/batch={batch_id}")
        if fs.exists(hadoop.Path(of(batch_id, -1))):
            batch.sparkSession.read.schema(CHANGES).parquet(of(batch_id, -1)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for part, had in versions.items():  # what no batch can ask for again
            for n in had if part == -1 else sorted(had)[:-1]:
                fs.delete(hadoop.Path(of(n, part)), True)

    sightings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spans(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """``store.break_spans`` from the changes of a stream: a span that is open was last seen by its entity's last run (``runs``: entity, seq)."""
    closed = F.col("change") == "closed"
    both = changes.where("change <> 'late'").groupBy("entity", "row_id", "opened_seq").agg(F.max(F.when(closed, F.col("last_seq"))).alias("seen"), F.max(F.when(closed, F.col("seq"))).alias("closed_seq"))
    last = runs.groupBy("entity").agg(F.max("seq").alias("now"))
    return both.join(last, "entity").select("entity", "row_id", "opened_seq", F.coalesce("seen", "now").alias("last_seen_seq"), "closed_seq")


def history(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """``store.merged_history`` after the last run of each entity, from the changes of a stream."""
    newest = Window.partitionBy("entity", "row_id").orderBy(F.desc("seq"))
    now = changes.where("change <> 'late'").withColumn("n", F.row_number().over(newest)).where("n = 1")
    last = runs.groupBy("entity").agg(F.max("seq").alias("now"))
    is_closed = F.col("change") == "closed"
    return now.join(last, "entity").select("row_id", "entity", "first_seq", F.when(is_closed, F.col("last_seq")).otherwise(F.col("now")).alias("last_seq"), F.when(is_closed, F.col("seq")).alias("closed_seq"))
