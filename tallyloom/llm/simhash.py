"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints collapse first, so copies never meet each other. What remains is cut into tiles of
fingerprints with equal population counts; two tiles are compared, all against all by exclusive-or and
bit counts, only if their counts don't rule out a distance within the radius. A pair of tiles returns a
spanning forest of its links, so that a dense group gives as many rows as members and no link between
components is lost. Distributed contraction then joins the forests.

Two tilings exist: ``quarters`` keys a tile by the population counts of the fingerprint's four
quarters, whose summed differences can't exceed the distance (small radius); ``sizes`` keys it by the
number of shingles, for which a similarity bounds the ratio, and by nothing else (large radius).

Wide fingerprints only propose: they are taken over a text's set of shingles, and what they link is
compared again, set by set, within each component of proposals. Only pairs whose exact similarity
reaches the bound count.

Defined cases: null and empty texts have fingerprint 0 and no shingles, and link like others; a very
long text is cut into words and its bits are added up in blocks, so that it takes 8 bytes a shingle; rows
with the same id share its smallest class; rows with a null id get the class of their fingerprint's
smallest id, null if none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored
from .components import components

#: Fingerprints of a tile, about, and rows of it that are compared at a time.
TILE, STRIP = 4096, 64
#: Words of a wide fingerprint, and bytes of a text that are cut into words at a time.
WIDE, BLOCK = 8, 1 << 20
_SPACE = re.compile(rb"\s")
#: Shingles of a tile of sets, about; each set counts SET_COST more, so that a tile holds at most 4,096 sets.
SET_TILE, SET_COST = 1 << 18, 64
#: Radius of proposals by the smaller count of distinct shingles: 220 below 8, 184 below 20 and so on. For a
#: Jaccard similarity of 0.8 the bits differ independently at a rate that depends on the sets' shapes and on
#: whether the smallest hashes, which decide ties, are shared. At the worst shape of each count the
#: rate is 0.31 for 5 shingles, 0.25 for 10, 0.23 for 18 and 0.18 for 60; beyond these radii lie fewer than one
#: pair in 10 million. Two unrelated texts differ in 256 bits on average.
WIDE_COUNTS, WIDE_RADII = (8, 20, 40), (220, 184, 168, 148)


def shingles(text: str | None, n: int) -> Iterator[list[bytes]]:
    """Shingles of n words, repeats included, a block of the text at a time; one of all words if there are fewer, none without words."""
    data, at, held, more = (text or "").encode().lower(), 0, [], False  # folds by ASCII only, as split() does
    while at < len(data):
        stop = _SPACE.search(data, at + BLOCK)
        end = stop.start() if stop else len(data)
        words = [*held, *data[at:end].split()]
        at = end
        if len(words) < n:
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield [joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
        held, more = words[len(words) - n + 1 :], True
    if held and not more:
        yield [b" ".join(held)]


def hashes_of(text: str | None, n: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of n words, in the text's order."""
    import xxhash

    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in block), np.uint64, len(block)) for block in shingles(text, n))])


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The hash of each distinct shingle of n words, in order."""
    return np.unique(hashes_of(text, n))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of each hash for each k: two rounds of multiply and shift."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    for multiplier, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(multiplier)
    return x ^ x >> np.uint64(31)


def bit_majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bytes whose bits are set in over half of the hashes and, for further words, of their mixes.

    With more than one word a bit set in just half of them is taken from the smallest hash, which keeps
    short texts' fingerprints apart. Bits are added up a block of hashes at a time.
    """
    bytes_of = lambda h: np.stack([h, *(mixed(h, k) for k in range(1, words))], axis=1).astype(">u8").view(np.uint8)
    n, twice = len(hashes), np.zeros(64 * words, np.int64)
    for at in range(0, n, 1 << 13):
        bits = np.unpackbits(bytes_of(hashes[at : at + (1 << 13)]), axis=1)
        for k in range(0, len(bits), 255):  # sums of so many bits fit in a byte
            twice += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    twice *= 2
    out = twice > n
    if words > 1 and n % 2 == 0 and n:
        out |= (twice == n) & (np.unpackbits(bytes_of(hashes.min(keepdims=True))[0]) == 1)
    return np.packbits(out)


def fingerprints(docs: DataFrame, words: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, n_shingles and the fingerprint in 64-bit words: w0, or with ``wide`` w0 to w7.

    The first word counts XXH64 with seed 42 of each shingle; further ones count mixes of that hash.
    Wide fingerprints count each distinct shingle once, as does their n_shingles, take ties from the
    smallest hash and come with a digest of the set, s0 and s1.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 8 * WIDE if wide else 8
        for batch in batches:
            n, out, sets = [], np.zeros((batch.num_rows, width), np.uint8), []
            for i, text in enumerate(batch["text"]):
                found = hashes_of(text.as_py(), words)
                if wide:
                    found = np.unique(found)
                    sets.append(xxhash.xxh3_128_digest(found.tobytes()))
                n.append(len(found))
                if len(found):
                    out[i] = bit_majority(found, width // 8)
            values = out.view(">i8").astype(np.int64)
            digests = np.frombuffer(b"".join(sets), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), *(pa.array(values[:, k]) for k in range(width // 8)), *(pa.array(digests[:, k]) for k in range(2 * wide))],
                names=["doc_id", "n_shingles", *(f"w{k}" for k in range(width // 8)), *(f"s{k}" for k in range(2 * wide))],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, w0 long" + "".join(f", w{k} long" for k in range(1, WIDE)) * wide + ", s0 long, s1 long" * wide)


def _forest(nodes: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest over ``nodes`` (ids) of links (index, indices) as two arrays of ids."""
    parent = np.arange(len(nodes))
    for i, others in links:
        at = np.append(others, i)
        roots = parent[at]
        while (up := parent[roots]).tobytes() != roots.tobytes():
            roots = up
        low = roots.min()
        parent[roots] = low
        parent[at] = low
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def wide_radius(counts: np.ndarray) -> np.ndarray:
    """The radius of proposals for each count of shingles."""
    return np.asarray(WIDE_RADII)[np.searchsorted(WIDE_COUNTS, counts, "right")]


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``a`` (rows of 64-bit words) the rows of ``b`` within the radius, shifted to their index among all."""
    for top in range(0, len(a), STRIP):
        strip = a[top : top + STRIP]
        left = top if same else 0  # each pair once
        far = np.zeros((len(strip), len(b) - left), np.uint16)
        for k in range(a.shape[1]):
            far += np.bitwise_count(strip[:, k, None] ^ b[None, left:, k])
            if k in (3, 5) and far.size and far.min() > radius:
                break  # distances only grow
        near = far <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            found = np.flatnonzero(near[i]) + left
            if same:
                found = found[found > top + i]
            if len(found):
                yield top + i, found + shift


def tiled_links(points: DataFrame, words: list[str], radius: int | None, quarters: bool, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what lies within ``radius``: ``points`` has node, n_shingles and ``words``.

    Without a radius that of the smallest count in two tiles holds, so links may lie somewhat further off.

    ``quarters``: tile by the population counts of four quarters of one word. Else tile by shingle
    count, and compare only counts whose ratio is at least ``similarity``.
    """
    if quarters:
        quarter = [F.bit_count(F.shiftrightunsigned(words[0], 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
        cell = sum((q * 17**k for k, q in enumerate(quarter)), F.lit(0)).cast("int")
        offsets = [
            (a, b, c, d) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1)
            for d in range(-radius, radius + 1) if abs(a) + abs(b) + abs(c) + abs(d) <= radius
        ]
    else:
        fine = 4  # cells in each factor of 1 / similarity
        cell = F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1)).cast("double")) * (fine / math.log(1 / similarity))).cast("int")
        cell = F.when(F.col("n_shingles") == 0, -fine - 2).otherwise(cell)
    points = points.withColumn("cell", cell)
    # at most 17^4 cells, or the logarithm of the longest text: bounded whatever the input's size
    cells = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks"))
    points = points.join(F.broadcast(cells), "cell")
    points = points.withColumn("chunk", F.pmod(F.xxhash64(*words), F.col("chunks")).cast("int"))
    tiles = points.groupBy("cell", "chunk").agg(F.collect_list(F.struct("node", "n_shingles", *words)).alias("x"))
    tiles = stored(tiles.select("cell", "chunk", *(F.col(f"x.{c}").alias(c) for c in ("node", "n_shingles", *words))), "tiles")
    keys = tiles.select("cell", "chunk")
    if quarters:
        step = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{k}") for k, v in enumerate(o))) for o in offsets)))
        plan = keys.select("cell", "chunk", step.alias("d"))
        digits = [F.pmod(F.floor(F.col("cell") / 17**k), F.lit(17)) + F.col(f"d.d{k}") for k in range(4)]
        valid = F.lit(True)
        for x in digits:
            valid = valid & x.between(0, 16)
        plan = plan.where(valid).select("cell", "chunk", sum((x * 17**k for k, x in enumerate(digits)), F.lit(0)).cast("int").alias("other"))
    else:
        plan = keys.select("cell", "chunk", F.explode(F.sequence(F.col("cell"), F.col("cell") + fine + 1)).alias("other"))
    there = keys.withColumnsRenamed({"cell": "other", "chunk": "other_chunk"})
    plan = plan.where("other >= cell").join(there, "other").where("other > cell OR other_chunk >= chunk")
    mine = tiles.withColumnsRenamed({c: f"a_{c}" for c in ("node", "n_shingles", *words)})
    yours = tiles.withColumnsRenamed({"cell": "other", "chunk": "other_chunk"} | {c: f"b_{c}" for c in ("node", "n_shingles", *words)})
    pairs = plan.join(mine, ["cell", "chunk"]).join(yours, ["other", "other_chunk"])

    def numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return batch[name][i].values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch["cell"][i].as_py() == batch["other"][i].as_py() and batch["chunk"][i].as_py() == batch["other_chunk"][i].as_py()
                a, b = (np.stack([numbers(batch, f"{s}_{w}", i).view(np.uint64) for w in words], axis=1) for s in "ab")
                nodes = numbers(batch, "a_node", i)
                counts = size = numbers(batch, "a_n_shingles", i)
                if not same:
                    nodes = np.concatenate([nodes, numbers(batch, "b_node", i)])
                    size = np.concatenate([size, numbers(batch, "b_n_shingles", i)])
                reach = int(wide_radius(size.min())) if radius is None else radius
                links = _close(a, b, reach, same, 0 if same else len(counts))
                if not quarters:
                    links = ((k, o[np.minimum(size[o], size[k]) >= similarity * np.maximum(size[o], size[k])]) for k, o in links)
                x, y = _forest(nodes, links)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _similar(nodes: np.ndarray, sets: list[np.ndarray], prints: np.ndarray, first: int, radius: int | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets whose Jaccard similarity reaches ``similarity``.

    ``first``: 0 compares all with all, else the first so many with the others. Only pairs within
    ``radius`` are counted out, and none that the forest connects already.
    """
    size, label = np.fromiter(map(len, sets), np.int64, len(sets)), np.arange(len(sets))
    for i in range(first or len(sets)):
        others = np.arange(first or i + 1, len(sets))
        others = others[(label[others] != label[i]) & (np.minimum(size[others], size[i]) / np.maximum(size[others], size[i]) >= similarity)]
        reach = wide_radius(np.minimum(size[others], size[i])) if radius is None else radius
        others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int32) <= reach]
        if len(others):
            there = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], there), size[i] - 1)
            shared = np.add.reduceat((sets[i][at] == there).astype(np.int64), np.cumsum(size[others]) - size[others])
            linked = others[shared / (size[i] + size[others] - shared) >= similarity]
            if len(linked):
                both = np.append(label[linked], label[i])
                label[np.isin(label, both)] = both.min()
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return nodes[moved], nodes[label[moved]]


def similar_links(docs: DataFrame, points: DataFrame, proposed: DataFrame, n_words: int, words: list[str], radius: int | None, similarity: float) -> DataFrame:
    """Links (a, b) that connect what is similar by its sets, within each component of the ``proposed`` ones.

    A large component is cut into tiles. Each is compared within itself and with the first; other
    pairs of tiles follow only if they aren't in one class by then, so a dense group costs a pass over it.
    """
    chosen = stored(points.join(components(proposed), "node").select("component", "node", "n_shingles", *words, "s0", "s1"), "proposed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                found = [shingle_set(text.as_py(), n_words) for text in batch["text"]]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), ">i8").astype(np.int64).reshape(-1, 2)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests[:, 0]), pa.array(digests[:, 1]), hashes], names=["node", "s0", "s1", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(chosen.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    known = texts.mapInArrow(sets, f"node {kind}, s0 long, s1 long, hashes array<long>").dropDuplicates(["node", "s0", "s1"])
    members = stored(chosen.join(known, ["node", "s0", "s1"]), "sets")
    chunks = members.groupBy("component").agg(F.ceil(F.sum(F.col("n_shingles") + SET_COST) / SET_TILE).cast("int").alias("chunks"))
    places = members.join(stored(chunks, "set-chunks"), "component").withColumn("chunk", F.pmod(F.xxhash64("s0", "s1"), F.col("chunks")).cast("int"))
    columns = ["node", *words, "hashes"]
    tiles = places.groupBy("component", "chunk").agg(F.collect_list(F.struct(*columns)).alias("x"))
    tiles = stored(tiles.select("component", "chunk", *(F.col(f"x.{c}").alias(c) for c in columns)), "set-tiles")
    mine = tiles.withColumnsRenamed({c: f"a_{c}" for c in columns})
    yours = tiles.withColumnsRenamed({"chunk": "other"} | {c: f"b_{c}" for c in columns})

    def part(batch: pa.RecordBatch, side: str, i: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        values = lambda c: batch[f"{side}_{c}"][i].values
        prints = np.stack([values(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in words], axis=1)
        return values("node").to_numpy(zero_copy_only=False), [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in values("hashes")], prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, held, prints = part(batch, "a", i)
                first = 0
                if batch["chunk"][i].as_py() != batch["other"][i].as_py():
                    first, more = len(nodes), part(batch, "b", i)
                    nodes, held, prints = np.concatenate([nodes, more[0]]), held + more[1], np.concatenate([prints, more[2]])
                x, y = _similar(nodes, held, prints, first, radius, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    def compared(plan: DataFrame, name: str) -> DataFrame:
        return stored(plan.join(mine, ["component", "chunk"]).join(yours, ["component", "other"]).mapInArrow(run, "a long, b long"), name)

    keys = tiles.select("component", "chunk")
    once = F.explode(F.array_distinct(F.array(F.lit(0), F.col("chunk")))).alias("first")
    links = compared(keys.select("component", F.col("chunk").alias("other"), once).withColumnRenamed("first", "chunk"), "similar")
    # what is left: pairs of tiles in which not all is one class yet
    large = stored(tiles.where("chunk > 0").select("component", "chunk", F.explode("node").alias("node")), "large")
    if large.isEmpty():
        return links
    of = large.join(components(links).withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    span = stored(of.groupBy("component", "chunk").agg(F.min("class").alias("low"), F.max("class").alias("high")), "spans")
    other = span.withColumnsRenamed({"chunk": "other", "low": "other_low", "high": "other_high"})
    rest = span.join(other, "component").where("chunk < other AND NOT (low = high AND other_low = low AND other_high = low)")
    return links.unionByName(compared(rest.select("component", "chunk", "other"), "similar-rest"))


def classes(prints: DataFrame, words: list[str], radius: int | None, quarters: bool, similarity: float = 0.8, verified: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``prints`` with component_id; rows of equal fingerprint (by sizes, of equal set) are one node; ``verified`` gets nodes and links and returns what holds."""
    key, rest = (words, ["n_shingles"]) if quarters else (["s0", "s1"], ["n_shingles", *words])
    alike = prints.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in rest))
    alike = stored(alike, "alike")
    points = alike.where("node IS NOT NULL")
    links = stored(tiled_links(points.select("node", "n_shingles", *words), words, radius, quarters, similarity), "links")
    if verified:
        links = verified(points, links)
    joined = alike.join(components(links), "node", "left").where("copies > 1 OR component IS NOT NULL")
    joined = joined.select(*key, F.coalesce("component", "node").alias("component_id"))
    # a key with very many copies is on the left only, whose large partitions Spark can split
    return prints.join(joined, key, "left").withColumn("component_id", F.coalesce("component_id", F.col("doc_id").cast("long")))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of three-word shingles, linked at two differing bits or fewer."""
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    prints = stored(fingerprints(docs), "fingerprints")
    return classes(prints, ["w0"], 2, True).select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, component_id: classes of documents that share 0.8 or more of their distinct five-word shingles.

    ``radius``, for another similarity than 0.8, replaces WIDE_RADII.
    """
    docs = id_and_text(docs, id_col)
    prints = stored(fingerprints(docs, words, wide=True), "fingerprints")
    names = [f"w{k}" for k in range(WIDE)]
    verified = lambda points, links: similar_links(docs, points, links, words, names, radius, similarity)
    return classes(prints, names, radius, False, similarity, verified).select("doc_id", "component_id")
