"""Each operator over nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import public_tokenizers
import pytest
import xxhash

import corpus_pipeline

from tallyloom.llm import chat, decontam, langid, licenses, media, packing, sharding, simhash, substring, warc
from tallyloom.llm.common import scratch_path

LONG = "the quick brown fox jumps over the lazy dog and runs home again tonight. " * 4000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (None, "der schnelle braune Fuchs springt über den faulen Hund und rennt weg", "de"),
    (None, None, None), (6, LONG, "en"), (7, "12345 !!!", "en"), (8, "x", "de"), (9, "Released under the MIT License.", "en"),
    (10, "eine schnelle braune Katze springt über die faule Maus und rennt heute weg", "de"),
]
SCHEMA = "doc_id long, text string, lang string"
#: Names that operators use themselves.
CLASH = ["shard", "slot", "score", "lang_pred", "length", "w0", "cell", "component_id", "unit", "start", "d0", "__gone", "node", "size", "k", "n"]
PATH = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in CLASH:
        docs = docs.selectExpr("*", f"'other' AS `{name}`")
    return docs


def languages(docs):
    return langid.predict(docs, langid.learn(docs), ["doc_id"])


OPERATORS = {
    "sharding": lambda d: sharding.shard(d, 3, scratch_path(d.sparkSession, "t-map")),
    "langid": languages,
    "simhash": lambda d: simhash.classes(simhash.fingerprints(d), ["w0"], 2, True).select("doc_id", "component_id"),
    "near": simhash.near_duplicates,
    "packing": lambda d: packing.pack(packing.pieces(d, PATH)),
    "substring": substring.removals,
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


def test_sharding(spark):
    out = OPERATORS["sharding"](documents(spark)).collect()
    assert len(out) == len(ROWS)
    assert sorted(r.size for r in out) == sorted(8 + len((t or "").encode()) for _, t, _ in ROWS)
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))


def test_repeated_rows_are_spread(spark):
    """A third of all rows is one row."""
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text").repartition(5)
    records = sharding.slotted(docs)
    assert records.where("doc_id IS NULL").groupBy("virtual_slot").count().agg({"count": "max"}).first()[0] < 10
    out = sharding.shard(docs, 24, scratch_path(spark, "t-map")).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == 3000 and len(loads) == 24 and loads.max() - loads.min() <= out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_langid(spark):
    out = {(r.doc_id, r.lang_pred) for r in OPERATORS["langid"](documents(spark)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (7, "und"), (None, "und"), (None, "de"), (1, "en")} <= out
    assert not [r for r in out if r[1] == "other"]


@pytest.mark.parametrize("name", ["simhash", "near"])
def test_classes(spark, name):
    out = OPERATORS[name](documents(spark)).collect()
    assert len(out) == len(ROWS)
    of = {r.doc_id: r.component_id for r in out}
    assert of[1] == of[2] == 1
    assert of[3] == of[4] == of[5] == 3  # no words: equal fingerprints
    assert of[6] == 6


def test_packing(spark):
    out = OPERATORS["packing"](documents(spark)).collect()
    assert {(r.doc_id, r.length) for r in out if r.doc_id in (3, 4, 5)} == {(3, 1), (4, 1), (5, 1)}
    assert sum(r.doc_id == 2 for r in out) == 2
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 6)
    assert len(long) > 1 and all(start == 2048 * piece for piece, start, _ in long) and all(n == 2048 for _, _, n in long[:-1])


def test_substring(spark):
    docs = documents(spark)
    out = {(r.doc_id, r.start, r.length, r.kept_doc_id) for r in substring.removals(docs).collect() if r.doc_id != 6}
    assert out == {(2, 0, len(ROWS[0][1]), 1)}
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(texts) == len(ROWS)
    assert texts.count((2, "")) == 2 and (1, ROWS[0][1]) in texts and (3, None) in texts
    assert dict(texts)[6].strip() == LONG[: LONG.index(".") + 1]  # its own repeats go too


def test_substring_null_ids_rank_last(spark):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(None, line), (None, line), (5, line)], "doc_id long, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in substring.removals(docs).collect()] == [(None, 5)]
    assert sorted(r.text for r in substring.without_repeats(docs).collect()) == ["", "", line]


@pytest.mark.parametrize("shared", [None, 3])
def test_substring_cuts_only_the_text_that_repeats(spark, shared):
    line = "one two three four five six seven eight nine"
    clean = "all of this text is clean and stands only here, so that nothing goes"
    docs = spark.createDataFrame([(1, line), (shared, f"{line}\nits own words"), (shared, clean), (shared, f"x\n{clean[:20]}\n{line}"), (shared, clean)], "doc_id long, text string")
    assert sorted((r.start, r.length) for r in substring.removals(docs).collect()) == [(0, len(line)), (23, len(line))]
    assert sorted(r.text for r in substring.without_repeats(docs).collect()) == sorted([line, "its own words", clean, clean, f"x\n{clean[:20]}"])
    twice = spark.createDataFrame([(shared, f"{line}\na b"), (shared, f"{line}\nc d"), (shared, f"y\n{line}")], "doc_id long, text string")
    assert sum(line in r.text for r in substring.without_repeats(twice).collect()) == 1


def test_licenses(spark):
    assert [(r.doc_id, r.license) for r in licenses.scan(documents(spark)).collect()] == [(9, "MIT")]


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (4, "x"), (4, "x")], "item_id long, text string").selectExpr("*", "'other' AS masks")
    docs = documents(spark)
    pairs = [(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()]
    assert set(pairs) == {(1, 1), (2, 1), (6, 1)} and pairs.count((2, 1)) == 2
    assert sorted((r.item_id, r.n_tokens) for r in decontam.too_short(bench).collect()) == [(2, 0), (3, 0), (4, 1), (4, 1)]  # a word removes no document
    left = decontam.without_overlaps(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "5", "None", "None", "7", "8", "9", "10"])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(docs, empty).count() == 0 and decontam.without_overlaps(docs, empty).count() == len(ROWS)
    assert decontam.overlaps(documents(spark, []), bench).count() == 0
    again = spark.createDataFrame([(1, "la " * 3000)], "doc_id long, text string")  # each window of the item at each of the text
    assert decontam.overlaps(again, spark.createDataFrame([(1, "la " * 300)], "item_id long, text string")).count() == 3000 + 300 - 2 * 12 + 1
    words = " ".join(f"w{k}" for k in range(20))
    odd = spark.createDataFrame([("a", f"İİİ {'İ' * 90} {words} ß"), ("b", "İ " * 50_000 + words.upper()), ("b", None)], "doc_id string, text string")
    item = spark.createDataFrame([("item-1", words)], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.start, r.end) for r in decontam.overlaps(odd, item).collect()) == [("a", "item-1", 95, 95 + len(words)), ("b", "item-1", 100_000, 100_000 + len(words))]


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a\\b ### </turn>"), (1, None, "assistant", ""), (None, 0, "assistant", "x" * 100_000), (1, 1, None, "a\\b ### </turn>")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'other' AS line", "'other' AS n")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chats)).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 0 and out[None].loss_chars == 100_000
    assert chat.digests(chat.formatted(chats.limit(0))).count() == 0


def test_warc(spark):
    html = "<p>" + "é" * 1000
    rows = [(1, "http://a b/\n", html), (2, None, html), (2, "http://c/", html), (None, "u", html), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.0\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'other' AS archive", "'other' AS offset")

    def back(pages):
        arc, out = scratch_path(spark, "t-arc"), scratch_path(spark, "t-warc")
        warc.write_arc(pages, arc, archive_bytes=2000)
        warc.convert(spark, arc, out)
        return warc.warc_records(spark, out).collect()

    out = back(pages)
    assert len(out) == len(rows)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in out if r.payload_bytes == len(html.encode())) == [
        ("1", "revisit", "2"), ("2", "response", "None"), ("2", "revisit", "2"), ("None", "revisit", "2")]
    assert {r.record_type for r in out if r.payload_bytes == 0} == {"response"}
    assert len({r.record_id for r in out}) == len(out)
    assert back(pages.limit(0)) == []


def test_media(spark):
    flat, bad = media.png(media.np.zeros((40, 40), "u1")), media.PNG_SIGNATURE + b"\x00"
    drawing = media.drawn([0.1, 0.2, 0.3])
    picture = media.png(drawing)
    rows = [(1, picture), (2, picture), (2, picture), (3, flat), (4, bad), (5, None), (None, picture), (6, b"")]
    images = spark.createDataFrame(rows, "media_id long, image binary").selectExpr("*", "'other' AS digest", "'other' AS votes")
    queries = spark.createDataFrame([(10, media.png(media.edited(drawing, 2))), (11, flat), (None, None)], "query_id long, image binary")
    out = media.copies(queries, images).collect()
    assert [(r.query_id, r.media_id, r.n_copies) for r in out] == [(10, 1, 3)]
    assert media.copies(queries.limit(0), images).count() == 0 and media.copies(queries, images.limit(0)).count() == 0
    large = media.np.kron(drawing, media.np.ones((45, 45), "u1"))  # beyond MAX_PIXELS, so reduced first
    points, _ = media.described(large)
    assert large.size > media.MAX_PIXELS and len(points) > 1000 and points[:, 0].max() > 3000


def test_shingles_in_blocks(monkeypatch):
    text = " ".join(f"W{k % 7}x{k % 11}" for k in range(500))
    whole = {n: simhash.hashes_of(text, n).tolist() for n in (1, 3, 5, 600)}
    words = text.lower().split()
    assert whole[3] == [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(498)]
    assert whole[600] == [xxhash.xxh64_intdigest(text.lower(), 42)]
    for block in (1, 10, 100):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {n: simhash.hashes_of(text, n).tolist() for n in whole} == whole
    assert not len(simhash.hashes_of(" \n", 3)) and not len(simhash.hashes_of(None, 3))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(("wind", "rain", "snow", "stone", "river", "cloud", "grass", "night", "light", "water", "field", "tower")) + str(rng.randrange(90)) for _ in range(n))


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (prose(k, 80) for k in range(4))
    near = a.rsplit(" ", 1)[0]
    rows = [(5, a, "x"), (5, b, "x"), (3, near, "y"), (9, b, "y"), (None, c, "x"), (None, d, "x"), (None, c, "z"), (7, d, "x"), (7, d, "a"), (8, None, "x"), (11, " ", "x")]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").selectExpr("*", "'other' AS node", "'other' AS __key", "'other' AS component_id")
    kept = corpus_pipeline.one_of_each_class(spark, docs, "")
    assert kept.columns == docs.columns
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert out == sorted([(3, near), (5, b), (None, c), (7, d), (8, None)], key=str)
    once = {(r.doc_id, r.source) for r in kept.collect()}
    assert once == {(r.doc_id, r.source) for r in corpus_pipeline.one_of_each_class(spark, docs.repartition(3, "source"), "").collect()}
    assert corpus_pipeline.one_of_each_class(spark, docs.limit(0), "").count() == 0


def test_pipeline_edges(spark, tmp_path):
    line = prose(20, 60)
    own = {k: prose(100 + k, 120) for k in range(8)}
    long = "\n".join(prose(1000 + k, 100) for k in range(2500))  # past one block of shingles
    rows = [(1, own[0]), (1, own[1]), (1, own[0]), (None, own[2]), (None, own[3]), (None, own[2]), (2, f"{own[4]}\n{line}"), (3, f"{line}\n{own[5]}"), (3, f"{own[6]}\n{line}"),
            (4, None), (5, ""), (6, "12 34"), (7, long), (8, f"{own[7]} {prose(50, 30)}")]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'other' AS start", "'other' AS length", "'other' AS cell", "'other' AS item_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(50, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.word_encoder(PATH)
    size = lambda t: len(encode(t)) // 4 + 1
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    want = {1: size(own[0]) + size(own[1]), None: size(own[2]) + size(own[3]), 2: size(f"{own[4]}\n{line}"), 3: size(own[5]) + size(own[6]), 7: size(long)}
    assert total == want
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
