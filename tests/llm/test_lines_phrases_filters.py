"""Line dedup, collocations and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import collocations, filter_audit, lines

CLASH = ["pos", "row", "h1", "line", "keep", "n_lines", "gone", "w1", "f", "a", "l", "r", "n", "rank", "part", "mask", "step", "bit", "fails", "words", "filter", "good"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).selectExpr("*", *(f"'other' AS `{c}`" for c in CLASH))


def brute_lines(rows, min_chars=40, min_docs=5):
    spaces = " \t\n\x0b\x0c\r"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    key = lambda x: low(x.strip(spaces))
    holders: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        top = lambda k: max(holders[k], key=lambda d: (d is not None, d or 0))
        left = [x for x in parts if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or top(key(x)) == i]
        out.append((i, len(parts), len(parts) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeÉéÄß", k=rng.randrange(3, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(6, 14))) for _ in range(12)]
    rows = []
    for i in range(60):
        body = [rng.choice([word(), " ".join(word() for _ in range(9)), "", " \t"]) for _ in range(rng.randrange(0, 6))]
        for line in rng.sample(shared, rng.randrange(0, 5)):
            body.insert(rng.randrange(len(body) + 1), rng.choice([line, f" \t{line}\x0b\r", line.upper(), line.capitalize(), line]))
        rows.append((i, "\n".join(body)))
    rows += [(7, rows[7][1]), (7, f"{shared[0]}\n{shared[0]}\n{shared[1]}\nx"), (None, f"{shared[2]}\nown\n{shared[2]}"), (None, shared[3]), (200, None), (201, ""), (202, "\n\n")]
    rows += [(100 + i, f"{'only without an id or few documents hold this':>50}") for i in range(4)] + [(None, "a line that just rows without an id have, many of them")] * 7
    return rows + [(-5, "\n".join([shared[4], "between"] * 5000))]


@pytest.mark.parametrize("few", [1000, 2])
def test_lines(spark, monkeypatch, few):
    """With ``few`` small the common lines are decided as hot ones."""
    monkeypatch.setattr(lines, "FEW_LINES", few)
    monkeypatch.setattr(lines, "HOT_KEYS", 5000)
    rows = line_rows()
    docs = frame(spark, rows, "doc_id long, text string")
    out = lines.without_repeats(docs)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 5000
    if few == 2:
        assert lines.hot_keys(lines.long_lines(lines.rows_of(docs))).count() > 5
    bitmaps = lines.keep_bitmaps(docs).collect()
    assert "text" not in bitmaps[0] and all(sum(x.length for x in r.keep) == r.n_lines - r.n_dropped for r in bitmaps)
    assert lines.without_repeats(docs.limit(0)).count() == 0


def test_lines_stay_in_the_jvm(spark):
    plan = lines.op11_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lower_case_of_a_to_z_only(spark):
    texts = ["ABC xyz", "ÄÖ abcÄ Z", "straße É", "ΑΣ S", "İstanbul I", "Ⅷ VIII", "中文 ABC", "é€–Q", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(lines.ascii_lower(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [t.encode().lower().decode() for t in texts]


def brute_phrases(rows, min_count, top):
    f: dict = {}
    for lang, text in rows:
        of = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                of.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in f.items():
        n = sum(c for p, c in of.items() if len(p) == 1)
        many = {p: c for p, c in of.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= 50 * a for q, c in many.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right, n))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right, n) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("tokens", "block"), [(2_000_000, 1 << 20), (50, 30), (7, 1)])
def test_phrases(spark, monkeypatch, tokens, block):
    """Also with shards and blocks so small that texts and phrases lie across them."""
    monkeypatch.setattr(collocations, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(3)
    words = ["New", "york", "CITY", "x", "éa", "Éa", "dès", "#", "\x01", " ", "ß"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choices(words, [9, 8, 7, 3, 2, 2, 2, 1, 1, 1, 1], k=rng.randrange(1, 60))).replace("x x", rng.choice([". ", "x\tx", ",x", "\n", "  "]))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("de", " .,"), ("xx", "new york city " * 300), ("en", "new york city. " * 40)]
    docs = frame(spark, rows, "lang string, text string").repartition(3)
    for top in (2000, 4):
        got = sorted(tuple(r) for r in collocations.collocations(docs, 4, top).collect())
        assert got == brute_phrases(rows, 4, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**13
    t = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long").select(collocations.scored("a", "l", "r", 1).alias("s")).first().s
    assert t.score == 10**6 * big * big // ((big + 7) * (big + 11))


def test_bitmaps_hold_the_frequent_parts(spark):
    words = [f"w{k}" for k in range(500)]
    table = spark.createDataFrame([("en", a, b) for a, b in zip(words, words[1:], strict=False)], "lang string, w1 string, w2 string")
    h1, h2 = F.xxhash64("lang", "w1"), F.xxhash64("lang", "w2")
    own = collocations.part_hashes("en", [w.encode() for w in words])
    assert int(own[3]) == xxhash.xxh64_intdigest(b"w3", xxhash.xxh64_intdigest(b"en", 42))
    single = collocations.bitmap_of(table.select(h1.alias("h")), 20)
    pair = collocations.bitmap_of(table.select(collocations.pair_hash_of(h1, h2).alias("h")), 20)
    assert collocations.has_bit(single, own[:-1]).all() and collocations.has_bit(pair, collocations.pair_hash(own[:-1], own[1:])).all()
    assert int(np.unpackbits(single).sum()) <= 499 and collocations.has_bit(single, collocations.part_hashes("fr", [w.encode() for w in words])).mean() < 0.05


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, source, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)}
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d in own if x in d[1] and not d[1] & before]
                shapley[x] += len(removed)
                out[part, order, step] = [sum(not d[1] & (before | {x}) for d in own), len(removed), sum(x in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {x} for d in own),
                                          sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    text = lambda: " ".join(rng.choices(words[: rng.choice((20, 400))], k=rng.choice((10, 49, 50, 90)))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOP" * 3, "\n", "\x0b"])
    rows = [(i, rng.choice(["a", "b", None]), text()) for i in range(80)]
    rows += [(i, "c", rows[rng.randrange(60)][2]) for i in range(90, 120)] + [(5, "a", rows[5][2]), (5, "a", rows[5][2]), (None, "a", rows[6][2]), (None, "b", rows[6][2])]
    rows += [(200, "d", None), (201, "d", ""), (202, "", " \t"), (203, None, None), (204, "long", " ".join(words) * 500)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in [*range(0, 120, 2), 4, 4, 200, None, 999]]
    docs = frame(spark, rows, "doc_id long, source string, text string")
    made = filter_audit.audited(filter_audit.cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("other"))))
    got = {(r["part"], r.filter_order, r["step"]): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in made.collect()}
    assert len(got) == 600 * 6 and got == brute_audit(rows, labels)
    assert filter_audit.audited(filter_audit.cells(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0
