"""Language identification by language-bitmask n-gram filters.

For each learned language the most frequent byte n-grams of its texts go into a Bloom filter. The
filters are bit-sliced: one table holds, per slot, a word with one bit per language, so that a single
look-up of an n-gram returns all languages that contain it. Per language the bits are counted over a
whole text, corrected for the filter's false positives, and the largest share decides.

Training sees about ``max_docs`` documents of each language (a share of it, by hash of the text)
and keeps ``top_grams`` n-grams of each: what reaches the driver is bounded by these two parameters
and the number of languages, whatever the input's size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language
that sorts first; with nothing to learn from, all is ``und``; rows with null or repeated ids are
ordinary rows; copies teach once; a row without label or text teaches nothing; a very long text is
counted in blocks; more labels than ``MAX_LANGUAGES`` are an error; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name

UND = "und"
GRAM = 4
#: Documents of a language that teach, about, n-grams kept of each, and languages at most.
MAX_DOCS, TOP_GRAMS, MAX_LANGUAGES = 4000, 6000, 1024
#: Slots of each of the two hash tables, as a power of two, and the hashes' odd multipliers.
SLOT_BITS = 18
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
#: All ASCII but letters becomes a space; other bytes stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "


def grams(buffer: bytes) -> np.ndarray:
    """The n-gram that starts at each byte, as a number; the last GRAM - 1 bytes start none."""
    a = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    return a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)


def slots(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for m in MULTIPLIERS:
        yield (codes * np.uint32(m)) >> np.uint32(32 - bits)


@dataclass
class Filters:
    """languages[i] is bit i % 64 of word i // 64; tables[hash][word] has a word for each slot."""

    languages: list[str]
    tables: np.ndarray
    bits: int

    @classmethod
    def build(cls, grams_of: dict[str, np.ndarray], bits: int = SLOT_BITS) -> Filters:
        languages = sorted(grams_of)
        tables = np.zeros((len(MULTIPLIERS), max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        for i, language in enumerate(languages):
            for table, at in zip(tables, slots(np.asarray(grams_of[language], np.uint32), bits), strict=True):
                table[i // 64][at] |= np.uint64(1 << i % 64)
        return cls(languages, tables, bits)

    def false_positive(self) -> np.ndarray:
        """Per language the chance that an n-gram outside its set hits in all tables."""
        rates = []
        for i in range(len(self.languages)):
            bit = np.uint64(1 << i % 64)
            rates.append(np.prod([np.mean(t[i // 64] & bit != 0) for t in self.tables]))
        return np.asarray(rates)

    def hits(self, blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows by block, columns by language: n-grams that the language contains; and n-grams by block."""
        ends = np.cumsum([len(t) for t in blocks])
        starts, counts = ends - [len(t) for t in blocks], np.asarray([max(0, len(t) - GRAM + 1) for t in blocks])
        codes = grams(b"".join(blocks))
        out = np.zeros((len(blocks), len(self.languages)), np.int64)
        masks = []
        for word in range(self.tables.shape[1]):
            found = np.full(len(codes), np.uint64(2**64 - 1))
            for table, at in zip(self.tables, slots(codes, self.bits), strict=True):
                found &= table[word][at]
            masks.append(found)
        for i in range(len(self.languages)):
            hit = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(hit)])
            out[:, i] = total[np.minimum(starts + counts, len(codes))] - total[np.minimum(starts, len(codes))]
        return out, counts

    def shares(self, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The share of n-grams that each language contains, corrected for false positives."""
        n, wrong = np.maximum(counts, 1)[:, None], self.false_positive()[None, :]
        return np.clip((hits / n - wrong) / (1 - wrong), 0, 1)


def _pieces(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts that have letters, folded, in groups of about ``limit`` bytes: memory stays bounded.

    A longer text comes in blocks, each with the start of the next, so that every n-gram is in one block.
    """
    at, group, size = [], [], 0
    for i, text in enumerate(texts):
        if text is not None and has_letter(text):
            whole = folded(text)
            for k in range(0, max(1, len(whole) - GRAM + 1), limit):
                at.append(i)
                group.append(whole[k : k + limit + GRAM - 1])
                size += len(group[-1])
                if size >= limit:
                    yield at, group
                    at, group, size = [], [], 0
    if group:
        yield at, group


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, top_grams: int = TOP_GRAMS) -> Filters:
    """Filters from (doc_id, text, lang)."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}  # a row per language
    if not counts:
        return Filters.build({})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels aren't languages")
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_docs / n))))
    # no ranking, hence no task that gathers a language's rows
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    sample = labelled.where(chosen).select("lang", "text").distinct()  # a text with very many copies teaches once

    def count(batches):
        for batch in batches:
            of: dict[str, list[str]] = {}
            for language, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                of.setdefault(language, []).append(text)
            for language, texts in of.items():
                for _, group in _pieces(texts):
                    codes, n = np.unique(grams(b"".join(group)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counted.withColumn("r", F.row_number().over(top)).where(F.col("r") <= top_grams).select("lang", "gram").toPandas()
    return Filters.build({k: v["gram"].to_numpy() for k, v in kept.groupby("lang")})


def predict(docs: DataFrame, filters: Filters, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs`` and lang_pred, score (or ``names``). Only ``text`` is an input of the prediction."""

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            language, score = [UND] * len(texts), np.zeros(len(texts))
            if filters.languages:
                hits, counts = np.zeros((len(texts), len(filters.languages)), np.int64), np.zeros(len(texts), np.int64)
                judged = np.zeros(len(texts), bool)
                for at, group in _pieces(texts):
                    h, n = filters.hits(group)
                    np.add.at(hits, at, h)
                    np.add.at(counts, at, n)
                    judged[at] = True
                shares = filters.shares(hits, counts)
                best = shares.argmax(axis=1)
                score = np.where(judged, shares[np.arange(len(texts)), best], 0.0)
                language = [filters.languages[b] if known else UND for b, known in zip(best.tolist(), judged.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(language, pa.string()), pa.array(score)], names=[*columns, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    need = dict.fromkeys([*columns, "text"])
    return docs.select(*(docs[f"`{c}`"] for c in need)).mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


#: Below this share of known n-grams a text is in none of the languages.
MIN_SCORE = 0.3


def in_a_language(docs: DataFrame, filters: Filters, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the learned languages."""
    language, score = free_name(docs, "__lang_pred"), free_name(docs, "__score")
    judged = predict(docs, filters, docs.columns, (language, score))
    return judged.where((F.col(language) != UND) & (F.col(score) >= min_score)).drop(language, score)


def held_out() -> F.col:
    """Documents that never teach: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out()))
    return predict(docs, filters, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
