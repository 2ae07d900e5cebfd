"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths and gaps are whole numbers up to the capacity, so both are kept range-sorted as runs: (length,
first rank, count) of documents and (gap, first sequence, count) of open sequences. A round has two
supersteps. First every range of sizes sweeps its own documents, longest first, over its own gaps: each
document's successor is the smallest gap that holds it, ranks decide who gets a contested run, and gaps
shrink. Then the longest class of documents that is left sweeps the gaps of all ranges, and opens
sequences for what no gap holds. Rounds go on class by class, down to the shortest. Runs, and so the
tables of a round and the final plan, are bounded by the capacity and not by the documents; they pass
from round to round as tables in the shared folder and never reach the driver. The documents
themselves get their rank within their length in parallel and find their place by a join on length
and rank.

Defined cases: a null or empty text is one token, the closing id 0; null and repeated ids and repeated
rows are separate documents; an empty table gives no rows; other columns are ignored. Only documents
longer than the capacity are cut.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, stored

CAPACITY = 2048
#: Parts in which each length is ranked in parallel: one for so many pieces, and so many at least.
ROWS_PER_PART, LEAST_PARTS = 100_000, 64
#: Ranges of sizes that a round sweeps side by side.
RANGES = 16
#: A class of lengths ends where so many fit in a sequence, and from there on at each power of two.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Words whose ids a task remembers.
REMEMBERED = 500_000


#: Latin letters that need no normalisation, then marks: what the tokenizer's rules take as one word and one run.
_PLAIN = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _SELF} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SELF)}


class Words(dict):
    """A word (bytes, A-Z in lower case, no white space) to its token ids, remembered.

    This vocabulary's rules never join what white space parts, and lower-case all, so a word's ids
    don't depend on its neighbours. Plain Latin words go to the vocabulary's merges at once, others
    through all of the tokenizer's rules.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self.parts.clear()
        text = word.decode()
        if plain := _PLAIN.fullmatch(text):
            stem, marks = plain.groups()
            ids = self.part(stem.lower()) + (self.part(marks) if marks else b"")
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def part(self, text: str) -> bytes:
        """Ids of letters alone or of marks alone."""
        if (ids := self.parts.get(text)) is None:
            letters = text if text.isascii() else "".join([_ALPHABET[b] for b in text.encode()])
            ids = self.parts[text] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


def word_encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    """text -> token ids as little-endian unsigned 32-bit numbers."""
    ids_of = Words(tokenizer_path).__getitem__

    def encode(text: str) -> bytes:
        return b"".join(map(ids_of, text.encode().lower().split()))  # bytes.lower() folds A-Z only, which commutes with the tokenizer's own rules

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of each document's pieces."""
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            out = [batch["doc_id"].take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sweep(documents: Iterable[tuple[int, int, int]], open_: Iterable[tuple[int, int, int]], capacity: int, new: int | None = None) -> tuple[list, list, list]:
    """One sweep, longest documents first, over open sequences: (placed, documents left, gaps left).

    ``documents``: (length, first_rank, n); ``open_``: (gap, first_sequence, n). Sequences open from
    number ``new`` on for what no gap holds; without it such documents are left. A placed row
    (length, first_rank, n, each, first_sequence, offset) puts n ranks, ``each`` to a sequence, one after
    another from ``offset`` on.
    """
    gaps: list[int] = []  # sorted sizes of gaps that have open sequences
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, n)
    placed: list[tuple[int, int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for run in sorted(open_):
        leave(*run)
    for length, rank, left in sorted(documents, key=lambda r: (-r[0], r[1])):
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            elif new is None:
                waiting.append((length, rank, left))
                break
            else:  # no gap holds this length
                gap, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            each = gap // length  # the sequence that a document went to stays the tightest that holds the next
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for many, start, size in ((full, first, each), (min(rest, 1), first + full, rest)):
                if many:
                    placed.append((length, rank, many * size, size, start, capacity - gap))
                    leave(gap - size * length, start, many)
                    rank, left = rank + many * size, left - many * size
            used = full + min(rest, 1)
            leave(gap, first + used, n - used)
    return placed, waiting, [(gap, first, n) for gap in gaps for first, n in runs[gap]]


_STATE = "kind string, size int, first long, n long, each int, sequence long, offset int"


def _swept(pdf: pd.DataFrame, capacity: int, new: int | None) -> pd.DataFrame:
    """The state after a sweep over all documents and gaps in ``pdf``."""
    runs = lambda kind: pdf.loc[pdf.kind == kind, ["size", "first", "n"]].itertuples(index=False, name=None)
    placed, waiting, gaps = sweep(runs("document"), runs("gap"), capacity, new)
    rows = [("placed", *r) for r in placed] + [(kind, *r, 0, 0, 0) for kind, left in (("document", waiting), ("gap", gaps)) for r in left]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])


def classes(capacity: int) -> list[int]:
    """The longest length of each class."""
    powers = [1 << k for k in range(5, capacity.bit_length())]
    return sorted({capacity // q for q in (*CLASSES, *powers) if q <= capacity}, reverse=True)


def rounds(state: DataFrame, capacity: int) -> DataFrame:
    """The placed runs of all documents of ``state`` (runs of documents by length, as ``_STATE``)."""
    longest = classes(capacity)
    class_of = sum(((F.col("size") <= top).cast("int") for top in longest[1:]), F.lit(0))
    occur = sorted(r[0] for r in state.select(class_of).distinct().collect())  # a few numbers

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return _swept(pdf, capacity, None)

    def from_number(new: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return _swept(pdf, capacity, new) if key[0] < 0 else pdf

        return across

    found = []
    for k in occur:
        ranges = state.groupBy(F.call_function("div", (F.col("size") - 1) * RANGES, F.lit(capacity)).alias("range"))
        swept = ranges.applyInPandas(within, _STATE)
        taking_part = (F.col("kind") == "gap") | ((F.col("kind") == "document") & (class_of == k))
        whole = swept.groupBy(F.when(taking_part, -1).otherwise(F.col("size") % RANGES).alias("part"))
        state = stored(whole.applyInPandas(from_number(k << 40), _STATE), "pack-round")
        found.append(state.where("kind = 'placed'"))
        state = state.where("kind <> 'placed'")
    return reduce(DataFrame.unionByName, found).select(F.col("size").cast("long").alias("length"), F.col("first").alias("first_rank"), "n", "each", F.col("sequence").alias("first_sequence"), "offset")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset."""
    salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())  # deals repeated rows out, and is fixed once written
    cut = stored(cut.withColumn("salt", salt), "pack-pieces")
    rows = cut.count()
    if not rows:
        return cut.drop("salt").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    cut = cut.withColumn("part", F.pmod("salt", F.lit(max(LEAST_PARTS, rows // ROWS_PER_PART))))
    counts = stored(cut.groupBy("length", "part").count(), "pack-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    zero = F.lit(0).cast("long")
    lengths = counts.groupBy("length").agg(F.sum("count").alias("n"))
    state = lengths.select(F.lit("document").alias("kind"), F.col("length").cast("int").alias("size"), zero.alias("first"), "n", F.lit(0).alias("each"), zero.alias("sequence"), F.lit(0).alias("offset"))
    plan = rounds(stored(state, "pack-lengths"), capacity)
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "salt"))
    ranked = cut.withColumn("k", rank).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    # the plan's rows depend on the lengths that occur, not on how often they do
    inside = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["first_rank"]) & (ranked["rank"] < plan["first_rank"] + plan["n"])
    ahead = ranked["rank"] - plan["first_rank"]
    return ranked.join(F.broadcast(plan), inside).select(
        *(ranked[c] for c in cut.columns if c not in ("part", "salt")),
        (plan["first_sequence"] + F.call_function("div", ahead, plan["each"])).alias("sequence_id"), (plan["offset"] + ahead % plan["each"] * plan["length"]).alias("offset"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
