"""Phrase collocation mining by count tries.

The trie grows by a level a pass: words, pairs, triples. In each pass a task counts the paths of its texts in a sorted
array for each language and shard of ``SHARD_TOKENS`` tokens, gives a full shard out in the order of its paths and
begins anew. The nodes are dealt out by prefix ranges: a range has all paths that begin with the same ``PREFIX``
characters, and is split in ``SPLITS`` by a hash of the path, as a few prefixes begin most words. A range's nodes are
sorted, so that equal paths of all shards meet and are added up; nodes with ``MIN_COUNT`` occurrences stay. No phrase is more frequent than its
parts, so a shard leaves out what has a rare part: it tests the parts in a bitmap of the frequent ones of the level
before, of 2 ** ``FILTER_BITS`` bits whatever the input. A bit that several parts share only lets more nodes through.

Walks up the trie give left parts: a triple meets its first pair, which brings its count and that of its first word.
Suffix links give right parts: a triple meets the pair of its last two words, which brings its own count and that of
the last word. A pair meets its two words.

The score of a cut is floor(1000000 * a * a / (l * r)) in decimals of 38 digits, exact up to 5 * 10**15 occurrences.

Defined cases: null texts are empty; a null lang is ``und``; a text of any length is cut into words block by block and
a phrase across two blocks counts; equal scores and counts go by the phrase's bytes; null ids and repeated rows are
ordinary rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

MIN_COUNT, TOP, INSIDE_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: A shard's tokens and words, and bytes of a text that are cut at a time.
SHARD_TOKENS, SHARD_WORDS, BLOCK = 2_000_000, 1 << 20, 1 << 20
#: Bits of the bitmap of frequent parts, as a power of two: 16 MB that go to each executor.
FILTER_BITS, BITMAP_BITS = 27, 1 << 15
#: Characters of a prefix range, and its splits.
PREFIX, SPLITS = 2, 64
#: Parts of a language that are ranked by themselves before their best ones meet.
RANK_PARTS = 64
PATH = ["w1", "w2", "w3"]
#: Marks of a place between pieces, and of nothing between two spaces.
STOP, NOTHING = -1, -2
_TABLE = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_SPACE = re.compile(rb"[ \n]")


class Words(dict):
    """Words numbered as they come."""

    def __init__(self) -> None:
        super().__init__({b"\n": STOP, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


class Shard:
    """The count trie of one language, filled from texts and given out as sorted nodes."""

    def __init__(self) -> None:
        self.begin([])

    def begin(self, carried: list[bytes]) -> None:
        self.words = Words()
        self.ids = [np.asarray([self.words[w] for w in carried], np.int64)]
        self.carried, self.size = len(carried), len(carried)

    def full(self) -> bool:
        return self.size >= SHARD_TOKENS or len(self.words) >= SHARD_WORDS

    def add(self, text: str) -> Iterator[None]:
        """Take a text in; halts after each block, so that a full shard can be given out."""
        data, at = text.encode().lower().translate(_TABLE), 0
        while at < len(data):
            cut = _SPACE.search(data, at + BLOCK)
            end = cut.start() if cut else len(data)
            self._take(data[at:end].replace(b"\n", b" \n ").split(b" "))
            at = end
            yield
        self._take([b"\n"])

    def _take(self, tokens: list[bytes]) -> None:
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        self.ids.append(ids[ids != NOTHING])
        self.size += len(self.ids[-1])

    def nodes(self, lang: str, depth: int, frequent: np.ndarray | None) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """The words in order, ``depth`` columns of word numbers and the counts of the level's nodes, by path. Begins anew."""
        words = list(self.words)[2:]
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.full(len(words) + 1, STOP, np.int64)  # the last place is a stop's
        rank[order] = np.arange(len(words))
        ids, width, new = np.concatenate(self.ids), len(words), self.carried
        r = rank[ids]
        at = np.arange(max(0, new - depth + 1), len(r) - depth + 1)  # places of paths that end beyond what was carried
        inside = np.ones(len(at), bool)
        for k in range(depth):
            inside &= r[at + k] >= 0
        at = at[inside]
        if depth > 1:
            hashes = part_hashes(lang, [words[i] for i in order])
            for k in range(2):  # both parts of all words but one
                h = hashes[r[at + k]]
                at = at[has_bit(frequent, h if depth == 2 else pair_hash(h, hashes[r[at + k + 1]]))]
        code = np.zeros(len(at), np.int64)
        for k in range(depth):
            code = code * width + r[at + k]
        paths, counts = np.unique(code, return_counts=True)
        columns = [paths // width ** (depth - 1 - k) % max(1, width) for k in range(depth)] if width else [paths] * depth
        tail = [words[i] if i >= 0 else b"\n" for i in ids[-2:].tolist()]
        names = pa.array([words[i].decode() for i in order], pa.string())
        self.begin(tail)
        return names, columns, counts


def part_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64(lang, word)``."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """As ``pair_hash_of``."""
    return first ^ (second << np.uint64(23) | second >> np.uint64(41))


def pair_hash_of(first: Column, second: Column) -> Column:
    return first.bitwiseXOR(F.shiftleft(second, 23).bitwiseOR(F.shiftrightunsigned(second, 41)))


def has_bit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def bitmap_of(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of the column ``h``: its size is fixed, so it may pass through the driver."""
    place = F.pmod("h", F.lit(1 << bits)) + 1  # buckets count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        at = (r.k - 1) * BITMAP_BITS // 8
        out[at : at + BITMAP_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)[: len(out) - at]
    return out


def _given(lang: str, shard: Shard, depth: int, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    names, columns, counts = shard.nodes(lang, depth, frequent)
    for at in range(0, len(counts), 100_000):
        n = len(counts[at : at + 100_000])
        part = [names.take(pa.array(c[at : at + n])) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *part, pa.array(counts[at : at + n], pa.int64())], names=["lang", *PATH[:depth], "f"])


def _counter(depth: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if shared is None else shared.value
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if (lang := lang.as_py()) not in shards:
                    if len(shards) == 64:  # a task's memory holds however many languages there are
                        for name in list(shards):
                            yield from _given(name, shards.pop(name), depth, frequent)
                    shards[lang] = Shard()
                for _ in shards[lang].add(text.as_py()):
                    if shards[lang].full():
                        yield from _given(lang, shards[lang], depth, frequent)
            if sum(s.size for s in shards.values()) >= SHARD_TOKENS:
                name = max(shards, key=lambda x: shards[x].size)
                yield from _given(name, shards[name], depth, frequent)
        for lang, shard in shards.items():
            yield from _given(lang, shard, depth, frequent)

    return run


def level(docs: DataFrame, depth: int, frequent: np.ndarray | None = None) -> DataFrame:
    """lang, w1 to the depth's word, f: the level's nodes of all shards (``docs``: lang, text), added up by prefix ranges."""
    path = ["lang", *PATH[:depth]]
    shared = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)
    nodes = docs.mapInArrow(_counter(depth, shared), ", ".join(f"{c} string" for c in path) + ", f long")
    parts = ["lang", "prefix", "split"]
    nodes = nodes.withColumns({"prefix": F.substring("w1", 1, PREFIX), "split": F.pmod(F.xxhash64(*path), F.lit(SPLITS))})
    return nodes.repartition(*parts).sortWithinPartitions("prefix", "split", *path).groupBy("prefix", "split", *path).agg(F.sum("f").alias("f")).drop("prefix", "split")


def scored(a: str, left: str, right: str, cut: int) -> Column:
    """(score, cut, l, r) of one cut."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * wide(a) * wide(a), wide(left) * wide(right))
    return F.struct(score.cast("long").alias("score"), F.lit(cut).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = stored(level(docs, 1), "words")
    words = every.where(F.col("f") >= min_count)
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    of = lambda w: F.xxhash64("lang", w)
    pairs = level(docs, 2, bitmap_of(words.select(of("w1").alias("h")))).where(F.col("f") >= min_count).withColumnRenamed("f", "a")
    right = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r"))
    pairs = stored(pairs.join(words.withColumnRenamed("f", "l"), ["lang", "w1"]).join(right, ["lang", "w2"]), "pairs")
    triples = level(docs, 3, bitmap_of(pairs.select(pair_hash_of(of("w1"), of("w2")).alias("h")))).where(F.col("f") >= min_count).withColumnRenamed("f", "a")
    parent = pairs.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    link = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = stored(triples.join(parent, ["lang", "w1", "w2"]).join(link, ["lang", "w2", "w3"]), "triples")
    inner = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = inner.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    alone = pairs.join(longest, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("a"), F.lit(True)))
    found = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", scored("a", "l", "r", 1).alias("best")).unionByName(
        triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(scored("a", "l1", "r1", 1), scored("a", "l2", "r2", 2)).alias("best")))
    found = found.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    for by in (["lang", "part"], ["lang"]):  # first within parts of a language, so that no task ranks all its phrases
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two and three words of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.k AS cut, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
  FROM candidates c JOIN f x ON c.lang = x.lang AND x.k < c.k AND x.p = c.p[1:x.k] JOIN f y ON c.lang = y.lang AND y.k = c.k - x.k AND y.p = c.p[x.k + 1:]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_pairs AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, f FROM candidates WHERE k = 3),
longest AS (SELECT lang, p, max(f) AS f FROM inner_pairs GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN longest g ON b.lang = g.lang AND b.p = g.p WHERE g.f IS NULL OR 100 * g.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
       a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
