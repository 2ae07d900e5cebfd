"""Repeated passages by hashing of lines (or paragraphs) and of runs of sentences.

Each text is cut into lines, or paragraphs between blank lines; each is normalised (lower case, runs of
white space as one space) and digested to 128 bits. Digests are grouped over all documents; the
occurrence with the smallest (doc_id, start) stays and all others are removed, which keep their offsets
in the original text. Lines of fewer than ``min_words`` words repeat by chance and are never removed.

Lines alone miss passages that stand within a line. So each sentence (it starts a line, follows a full
stop or begins with a capital) also starts a run of as many whole sentences as reach ``RUN_WORDS``
words, and runs are grouped like lines. A sentence of more than ``LONG_SENTENCE`` words, as in texts without
stops and capitals, is cut further, where a hash of two words says so: at the same words in every text that has
them. Removed units that touch are given as one span.

Defined cases: a null text has no units and stays null; an empty one stays; rows with a null id rank
last; rows that share an id (or have none) and the text count as one document (a unit at the same place
in them is one occurrence, so repeated rows don't empty each other), rows that share an id with
different texts are documents of their own, in the order of a hash of the text; an occurrence that overlaps the kept one stays;
a very long text gives its units a row each; an empty table gives no rows; other columns are kept by
``without_repeats`` and ignored by ``removals``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, id_and_text, stored

LINE, PARAGRAPH = "\n", "\n\n"
MIN_WORDS, RUN_WORDS = 8, 13
#: Sentences beyond so many words are cut before about one word in ANCHOR.
LONG_SENTENCE, ANCHOR = 2 * RUN_WORDS, 8
_WORD = re.compile(r"\S+")
#: A sentence's first character: in a line's beginning, after a full stop, or a capital after white space.
_SENTENCE = re.compile(r"(?:(?<=[.!?]\s)|(?<![^\n]))\S|(?<=\s)[A-ZÀ-ÖØ-Þ]")


def line_units(text: str, separator: str, min_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of each line or paragraph that is long enough."""
    at = 0
    for part in text.split(separator):
        words = part.lower().split()
        if len(words) >= min_words:
            yield at, at + len(part), words
        at += len(part) + len(separator)


def anchors(sentence: str) -> list[int]:
    """Where a long sentence is cut: before words that a hash of them and the next one chooses."""
    found = [(m.start(), m[0].lower()) for m in _WORD.finditer(sentence)]
    return [at for (at, word), (_, then) in zip(found[1:], found[2:], strict=False) if zlib.crc32(f"{word} {then}".encode()) % ANCHOR == 0]


def sentence_runs(text: str, run_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of the shortest run of whole sentences from each sentence that is long enough."""
    starts, sentences, words = [], [], []
    first = [m.start() for m in _SENTENCE.finditer(text)]
    for a, b in zip(first, [*first[1:], len(text)], strict=False):
        own = text[a:b].lower().split()
        cuts = [0, *anchors(text[a:b])] if len(own) > LONG_SENTENCE else [0]
        for x, y in zip(cuts, [*cuts[1:], b - a], strict=True):
            starts.append(a + x)
            sentences.append(text[a + x : a + y])
            words.append(sentences[-1].lower().split() if len(cuts) > 1 else own)
    last, held = 0, 0
    for k, start in enumerate(starts):
        while held < run_words and last < len(words):
            held += len(words[last])
            last += 1
        if held < run_words:
            return
        yield start, starts[last - 1] + len(sentences[last - 1].rstrip()), [w for s in words[k:last] for w in s]
        held -= len(words[k])


def units(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, a hash of the text, start, length (in code points), n_words, and the digest as d0 and d1, of all lines and runs."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                row, numbers, digests = [], [], []
                for i, value in enumerate(batch["text"]):
                    text = value.as_py() or ""
                    places = {(a, b): words for a, b, words in line_units(text, separator, min_words)}
                    places |= {(a, b): words for a, b, words in sentence_runs(text, run_words)}
                    row += [i] * len(places)
                    numbers += [(a, b - a, len(words)) for (a, b), words in places.items()]
                    digests += [xxhash.xxh3_128_digest(" ".join(words).encode()) for words in places.values()]
                columns = np.asarray(numbers, np.int32).reshape(-1, 3)
                two = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(pa.array(row, pa.int32())) for c in ("doc_id", "of_text")), *(pa.array(columns[:, k]) for k in range(3)), pa.array(two[:, 0]), pa.array(two[:, 1])],
                    names=["doc_id", "of_text", "start", "length", "n_words", "d0", "d1"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("of_text")).mapInArrow(run, f"doc_id {kind}, of_text long, start int, length int, n_words int, d0 long, d1 long")


def removals(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, start, length, kept_doc_id, kept_start of each repeated span.

    Spans are unions of removed units; kept_… is the earliest place that its first unit repeats.
    """
    return _spans(docs, separator, min_words, run_words).drop("of_text")


def _spans(docs: DataFrame, separator: str, min_words: int, run_words: int) -> DataFrame:
    """The spans of ``removals`` with the hash of the text that they lie in."""
    found = stored(units(id_and_text(docs), separator, min_words, run_words), "units")
    digest = ["d0", "d1"]
    # counted before the shuffle; most units occur once and are met by this count alone
    many = stored(found.groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*digest), "unit-digests")
    again = stored(found.join(many, digest, "left_semi"), "repeated-units")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "of_text", "start", "length")
    first = again.groupBy(*digest).agg(F.min(place).alias("kept"))
    first = stored(first.select(*digest, F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.of_text").alias("kept_of_text"), F.col("kept.start").alias("kept_start"), F.col("kept.length").alias("kept_length")), "first-units")
    # the many occurrences of one digest are on the left only, where Spark can split them: both sides are plain tables
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("of_text") == F.col("kept_of_text"))
    gone = again.join(first, digest).where(~(same & (F.col("start") < F.col("kept_start") + F.col("kept_length"))))
    # one document's units: those that touch become one span
    order = Window.partitionBy("doc_id", "of_text").orderBy("start", F.desc("length"), "kept_doc_id", "kept_start")
    end = F.col("start") + F.col("length")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    start = F.min(F.struct("start", -F.col("length"), "kept_doc_id", "kept_start"))
    spans = islands.groupBy("doc_id", "of_text", "span").agg(start.alias("f"), F.max(end).alias("e"))
    return spans.select("doc_id", "of_text", F.col("f.start").alias("start"), (F.col("e") - F.col("f.start")).alias("length"), F.col("f.kept_doc_id").alias("kept_doc_id"), F.col("f.kept_start").alias("kept_start"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its spans (start, end); a line that goes as a whole takes its line end along."""
    out, at = [], 0
    for start, end in sorted(spans):
        whole = (start == 0 or text[start - 1] == "\n") and (end == len(text) or text[end] == "\n")
        if whole and end < len(text):
            end += 1
        elif whole and start > at:
            start -= 1
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, separator: str = LINE, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; n_chars, where there is one, follows."""
    cut, key = free_name(docs, "__gone"), free_name(docs, "__id")
    gone = _spans(docs, separator, min_words, run_words)
    gone = gone.groupBy(F.col("doc_id").alias(key), F.col("of_text").alias(f"{cut}t")).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"))
    gone = gone.select(key, f"{cut}t", F.col("spans.start").alias(f"{cut}a"), F.col("spans.end").alias(f"{cut}b"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]) & (F.xxhash64(docs["text"]) == gone[f"{cut}t"]), "left").drop(key, f"{cut}t")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch["text"].to_pylist(), batch["n_chars"].to_pylist() if "n_chars" in names else None
            for i, (a, b) in enumerate(zip(batch[f"{cut}a"].to_pylist(), batch[f"{cut}b"].to_pylist(), strict=True)):
                if a and texts[i] is not None:
                    texts[i] = cut_out(texts[i], list(zip(a, b, strict=True)))
                    if sizes:
                        sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, batch.schema.field("text").type)} | ({} if sizes is None else {"n_chars": pa.array(sizes, batch.schema.field("n_chars").type)})
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in names], names=names)

    return joined.mapInArrow(run, docs.schema)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    """All repeated spans of documents but the earliest occurrence of each."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
