"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some positions of a window of tokens and ignore the others, so that a window still
hashes alike after substitutions at ignored positions. Hashes of all windows of the benchmark are
joined with those of all windows of the documents; around each hit the two texts are laid over each
other and the best run is scored, a match +1 and a substitution -3. The run counts if its matches
reach ``MIN_MATCHED`` tokens or ``MIN_SHARE`` of a shorter item.

The benchmark is the stated query set. It is taken in blocks of about ``BLOCK_TOKENS`` tokens; each
block is broadcast (its size is bounded by that parameter and the longest item) and meets all documents,
so a benchmark of any size is matched in full.

Tokens are runs of letters and digits, compared without case; places are offsets in the text as it is.

The masks lose nothing that the verification would accept: every way to lay an item of 8 tokens or more over a text
that reaches the bound holds a window of one of its masks (the tests try all ways up to 16 tokens, and for longer ones all texts that no window hits).

Defined cases: null texts and texts without a letter or digit match nothing; items of fewer than ``MIN_TOKENS``
tokens say too little and match nothing, ``too_short`` lists them; items of fewer than ``EXACT_BELOW`` tokens are
matched whole and exactly; a run lies in one document, also where the next one
goes on with the item; items and documents that occur twice, and rows with a null id, give rows each;
a very long text is hashed as one array of 8 bytes a token; ids keep their types; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_and_text, stored

#: Windows of up to 13 tokens of which 7 count, for items of 12 tokens or more; of 6 of which 5 count, for shorter ones.
MASKS, SHORT_MASKS = ("1110011011", "10011101011", "1001010011011"), ("111011",)
LONG_FROM, EXACT_BELOW, MIN_TOKENS = 12, 8, 4
MIN_MATCHED, MIN_SHARE = 12, 0.8
BLOCK_TOKENS = 1_000_000
#: Tokens of documents that are hashed at a time, and words that a task remembers.
GROUP_TOKENS, REMEMBERED, HITS = 200_000, 500_000, 500_000
#: An odd multiplier for each position of a window, by a rule.
FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 2**64) | 1 for k in range(16)]
_TOKEN = re.compile(r"[^\W_]+")
_FILTER_BITS = 22


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


class Words(dict):
    """Token to the 64-bit hash of its lower-case form, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.lower().encode())
        return value


def offsets_of(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def window_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the window that starts at each token; windows that don't fit have none."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask) * 1_000_003 + int(mask, 2)))
    for k, at in enumerate(offsets_of(mask)):
        out += codes[at : at + n] * np.uint64(FACTORS[k])
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` tokens."""
    if n < EXACT_BELOW:
        return ("1" * n,) if n >= MIN_TOKENS else ()
    return MASKS if n >= LONG_FROM else SHORT_MASKS


@dataclass
class Block:
    """Benchmark items: their tokens end to end, and each window's hash with its place, sorted by hash."""

    item_ids: list
    bounds: np.ndarray
    codes: np.ndarray
    masks: list[str]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[object, str]]) -> Block:
        words = Words()
        coded = [np.asarray([words[w] for w in tokens(text)], np.uint64) for _, text in rows]
        masks, found = [], []
        for j, codes in enumerate(coded):
            for mask in masks_of(len(codes)):
                if mask not in masks:
                    masks.append(mask)
                h = window_hashes(codes, mask)
                found.append((h, np.full(len(h), j, np.int64), np.arange(len(h))))
        hashes, items, places = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(3))
        order = np.argsort(hashes, kind="stable")
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
        return cls([i for i, _ in rows], bounds, np.concatenate(coded) if coded else np.zeros(0, np.uint64), masks, hashes[order], items[order], places[order])

    def present(self) -> np.ndarray:
        flags = np.zeros(1 << _FILTER_BITS, bool)
        flags[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return flags


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the highest score: +1 where equal, -3 elsewhere."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def matches(codes: np.ndarray, bounds: np.ndarray, block: Block, present: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, start in document, start in item, length, matched) of the runs that count.

    ``codes`` holds the documents end to end, document k from ``bounds[k]`` to ``bounds[k + 1]``.
    """
    found = np.zeros((3, 0), np.int64)
    for mask in block.masks:
        hashes = window_hashes(codes, mask)
        maybe = np.flatnonzero(present[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        doc = np.searchsorted(bounds, maybe, "right") - 1
        inside = maybe + len(mask) <= bounds[doc + 1]
        maybe, doc = maybe[inside], doc[inside]
        low = np.searchsorted(block.hashes, hashes[maybe], "left")
        many = np.searchsorted(block.hashes, hashes[maybe], "right") - low
        ends = np.cumsum(many)
        at = 0
        while at < len(many):  # as many windows at a time as give about HITS ways to lay an item over a text
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
            n, place = many[at:end], maybe[at:end] - bounds[doc[at:end]]
            entry = np.repeat(low[at:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            laid = np.stack([np.repeat(doc[at:end], n), block.items[entry], np.repeat(place, n) - block.places[entry]])
            found = np.unique(np.concatenate([found, laid], axis=1), axis=1)
            at = end
    for d, j, shift in found.T.tolist():
        item, text = block.codes[block.bounds[j] : block.bounds[j + 1]], codes[bounds[d] : bounds[d + 1]]
        first, last = max(0, -shift), min(len(item), len(text) - shift)
        equal = item[first:last] == text[first + shift : last + shift]
        start, end = best_run(equal)
        matched = int(equal[start:end].sum())
        if matched >= min(MIN_MATCHED, math.ceil(MIN_SHARE * len(item))):
            yield d, j, first + shift + start, first + start, end - start, matched


def _groups(texts: Iterator[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    group, size = [], 0
    for i, text in enumerate(texts):
        if found := tokens(text):
            group.append((i, found))
            size += len(found)
            if size >= GROUP_TOKENS:
                yield group
                group, size = [], 0
    if group:
        yield group


def overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, doc_token, item_token, n_tokens, matched, start, end (code points) of each overlap."""
    docs = id_and_text(docs)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_token int, item_token int, n_tokens int, matched int, start int, end int"
    out = None
    for shared in blocks(benchmark, block_tokens):
        part = docs.mapInArrow(_finder(shared, to_arrow_type(benchmark.schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no benchmark item.

    What one block leaves is written before the next block meets it, so a task holds one block.
    """
    schema, before = docs.schema, None
    for shared in blocks(benchmark, block_tokens):
        if before:
            docs = stored(docs, "left-by-block")
            before.unpersist()
        docs, before = docs.mapInArrow(_dropper(shared), schema), shared
    return docs


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id, n_tokens of the items that are left out, a null text having none."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?U)[^\W_]+")).alias("n_tokens")
    return benchmark.select("item_id", n).where(F.col("n_tokens") < MIN_TOKENS)


def blocks(benchmark: DataFrame, block_tokens: int) -> Iterator:
    """Broadcasts of the benchmark's blocks, each bounded by ``block_tokens`` and the longest item."""
    benchmark = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_tokens))
    for n in range(n_blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == n).collect()
        block = Block.build([(r["item_id"], r["text"]) for r in rows])
        # arrays alone: executors needn't have this module
        yield benchmark.sparkSession.sparkContext.broadcast(tuple(vars(block).values()))


def _found(texts: pa.Array, block: Block, present: np.ndarray, words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, first token, first token in the item, tokens, matched) of the overlaps of a batch."""
    for group in _groups(t.as_py() for t in texts):
        coded = np.fromiter((words[w] for _, found in group for w in found), np.uint64)
        bounds = np.cumsum([0, *(len(found) for _, found in group)])
        for g, j, at, in_item, n, matched in matches(coded, bounds, block, present):
            yield group[g][0], j, at, in_item, n, matched


def _finder(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words = Block(*shared.value), Words()
        present = block.present()
        for batch in batches:
            row, item, numbers, of, spans = [], [], [], None, []
            for i, j, first, in_item, n, matched in _found(batch["text"], block, present, words):
                if of != i:  # a document's matches follow each other
                    of, spans = i, [m.span() for m in _TOKEN.finditer(batch["text"][i].as_py())]
                row.append(i)
                item.append(block.item_ids[j])
                numbers.append((first, in_item, n, matched, spans[first][0], spans[first + n - 1][1]))
            columns = np.asarray(numbers, np.int32).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row, pa.int32())), pa.array(item, item_type), *(pa.array(columns[:, k]) for k in range(6))],
                names=["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "matched", "start", "end"],
            )

    return run


def _dropper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words = Block(*shared.value), Words()
        present = block.present()
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            kept[[i for i, *_ in _found(batch["text"], block, present, words)]] = False
            yield batch.filter(pa.array(kept))

    return run


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """All overlaps of documents with the benchmark."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
