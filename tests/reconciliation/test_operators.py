"""Operators without SQL against brute force and golden cases."""

import itertools
import json
import random
import tracemalloc
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import calendar, money, text
from tallyloom.operators import aggregates, audit, cascade, closures, gates, joins, resolver, store, subsets, tax
from tallyloom.plans import fixtures
from tallyloom.sources import arrays, files, statements
from tallyloom.streaming import breaks, ingest

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(-30, 30).filter(bool), max_size=9), st.integers(-40, 60))
@settings(max_examples=150, deadline=None)
def test_closing_subsets(nets, target):
    ids = [f"r{k}" for k in range(len(nets))]
    found, complete, _ = subsets.closing_subsets(ids, nets, target, cap=10_000)
    want = sorted(c for n in range(1, len(ids) + 1) for c in itertools.combinations(ids, n) if sum(nets[int(i[1:])] for i in c) == target)
    assert complete and found == (want if ids else [()] * (target == 0))


def test_truncation_is_told():
    found, complete, status = subsets.closing_subsets([f"r{k}" for k in range(8)], [1] * 8, 4, cap=5)
    assert (len(found), complete, status) == (5, False, "cap_reached")
    few, complete, status = subsets.closing_subsets([f"r{k:02}" for k in range(60)], [1] * 60, 4)
    assert (len(few), complete, status) == (200, False, "cap_reached")
    assert subsets.closing_subsets([f"r{k:02}" for k in range(60)], [2] * 60, 5) == ([], True, "exhausted")  # sums of equal rows are few
    one = subsets.closing_subsets([f"r{k:02}" for k in range(60)], [3**k % 1_000_003 + 10**7 for k in range(60)], 3**7 % 1_000_003 + 10**7)
    assert one == ([("r07",)], True, "exhausted")  # no two rows are as little as that
    assert subsets.closing_subsets([], [], 0) == ([()], True, "empty_pool")


@given(st.lists(st.integers(-30, 30).filter(bool), max_size=9), st.integers(-40, 60), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_most_debits_before_the_cap(nets, target, cap):
    ids = [f"r{k}" for k in range(len(nets))]
    found, complete, status = subsets.closing_subsets(ids, nets, target, cap=cap, most_debits=True)
    every = [c for n in range(1, len(ids) + 1) for c in itertools.combinations(ids, n) if sum(nets[int(i[1:])] for i in c) == target]
    debits = lambda c: sum(nets[int(i[1:])] < 0 for i in c)
    want = {c for c in every if debits(c) == max(map(debits, every))}
    if ids:
        assert set(found) <= want and len(found) == min(cap, len(want)) and complete == (len(want) <= cap)


def test_most_debits_of_many():
    ids, nets = [f"c{k:02}" for k in range(12)] + [f"d{k:02}" for k in range(12)], [10] * 12 + [-10] * 12
    found, complete, status = subsets.closing_subsets(ids, nets, 10, cap=32, most_debits=True)
    assert {sum(i[0] == "d" for i in s) for s in found} == {11} and (len(found), complete) == (12, True)
    assert not subsets.closing_subsets(["a", "b"], [5, 6], 0, most_debits=True)[0]


@given(st.lists(st.integers(-12, 12), min_size=5, max_size=11), st.integers(-20, 40))
@settings(max_examples=80, deadline=None)
def test_few_rows_and_beginnings(nets, target):
    """The three ways through a pool that is too large, each by itself: what it names, and that the last one's claim holds."""
    n, pool = len(nets), closures.Pool(nets)
    every = {c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if sum(nets[i] for i in c) == target}
    most = 2 * (len(closures._lists(pool)) - 1)
    few, out = list(closures._few(pool, target)), list(closures._few_left_out(pool, target))
    assert len(set(few)) == len(few) and set(few) == {c for c in every if len(c) <= most}
    assert len(set(out)) == len(out) and set(out) == {c for c in every if len(c) >= n - most}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(closures, "LISTED", 40)
        patch.setattr(closures, "HALF", 4)
        patch.setattr(closures, "BEGINNINGS", 5000)
        most = 2 * (len(closures._lists(pool)) - 1)
        assert set(closures._few(pool, target)) == {c for c in every if len(c) <= most}
        ended = [False]
        deep = list(closures._deep(pool, target, ended))
        assert ended[0] and len(set(deep)) == len(deep) and set(deep) == every
        assert closures.search(nets, target, 10**6, 2)[1:] == (True, "exhausted")


def test_sets_of_a_large_pool():
    """Eight rows of sixty; half of sixty; nearly all of three hundred; memory of equal amounts; one answer that just its own search proves."""
    rng = random.Random(8)
    values = [rng.randrange(10_000, 9_000_000) for _ in range(60)]
    ids = [f"r{k:03}" for k in range(300)]
    eight = tuple(sorted(rng.sample(ids[:60], 8)))
    target = sum(values[int(i[1:])] for i in eight)
    found, complete, status = subsets.closing_subsets(ids[:60], values, target)
    assert eight in found and not complete and status in ("budget_exceeded", "cap_reached")
    assert all(sum(values[int(i[1:])] for i in s) == target for s in found)
    half = sum(values[:30])
    found, complete, status = subsets.closing_subsets(ids[:60], values, half)
    assert len(found) == 200 and (complete, status) == (False, "cap_reached") and all(sum(values[int(i[1:])] for i in s) == half for s in found)
    many = [rng.randrange(1, 9_000_000) for _ in range(300)]
    assert tuple(ids[3:]) in subsets.closing_subsets(ids, many, sum(many[3:]), cap=5000)[0]
    tracemalloc.start()
    found, complete, status = subsets.closing_subsets(ids, [500] * 300, 500 * 296)
    assert len(found) == 200 and (complete, status) == (False, "cap_reached")
    subsets.closing_subsets(ids, [500 + k % 7 for k in range(300)], 500 * 150)
    subsets.closing_subsets(ids, many, sum(many[:90]))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    doubled = [2**k for k in range(60)]  # each sum has one set; bounds decide all large amounts
    assert subsets.closing_subsets(ids[:60], doubled, 2**59 + 5) == ([(ids[0], ids[2], ids[59])], True, "exhausted")
    assert subsets.closing_subsets(ids[:60], [2 * v for v in values], 2 * half + 1)[:2] == ([], True)
    best, sets, proven = subsets.largest_under_cap(ids[:60], values, half)
    assert (best, proven) == (half, True) and sets
    assert subsets.largest_under_cap(ids[:60], doubled, 2**50 - 1)[0] <= 2**50 - 1


def test_pools_too_large_to_gather(spark):
    pools = spark.createDataFrame([(1, 1, 50, f"r{k:03}", 50 if k in (7, 9) else 1) for k in range(80)] + [(1, 2, 5, "a", 5)], "entity long, bank_index long, target long, row_id string, net long")
    out = sorted((r.bank_index, r.row_ids, r.complete, r.status) for r in subsets.enumerate_lines(pools, max_pool=60).collect())
    assert out == [(1, "r007", False, "pool_too_large"), (1, "r009", False, "pool_too_large"), (2, "a", True, "exhausted")]


def test_row_search_against_brute_force(spark):
    """Candidates, rivals and outcomes of all lines again, from the ledger in memory."""
    from tallyloom.plans import resolution

    ledger = fixtures.ledger(spark, SF)
    of: dict = {}
    for r in ledger.collect():
        of.setdefault(r.entity, []).append(r)
    decided = resolver.tiers_a_and_b(ledger, fixtures.bank(ledger), fixtures.report(ledger)).collect()
    used = {(d.entity, d.settlement_id): d.seq for d in decided if d.kind == "verified"}

    def closings(d):
        ceiling = (d.value_day + 1) * 86_400 - 19_800
        pool = []
        for r in of[d.entity]:
            day = (r.created_at + 19_800) // 86_400
            at = r.created_at if r.type != "payment" else (day + {4: 4, 5: 4, 6: 3}.get((day + 4) % 7, 2)) * 86_400 + 39_600 - 19_800
            if r.credit != r.debit and (r.type != "payment" or r.credit) and max(at, r.created_at) <= ceiling and used.get((d.entity, r.settlement_id), d.seq) >= d.seq:
                pool.append((r.row_id, r.credit - r.debit))
        half = {0: [()]}
        for row, net in pool[: len(pool) // 2]:
            half = {s: half.get(s, []) + [(*x, row) for x in half.get(s - net, [])] for s in {*half, *(k + net for k in half)}}
        rest = {0: [()]}
        for row, net in pool[len(pool) // 2 :]:
            rest = {s: rest.get(s, []) + [(*x, row) for x in rest.get(s - net, [])] for s in {*rest, *(k + net for k in rest)}}
        return sorted("|".join(sorted(a + b)) for s, left in half.items() for a in left for b in rest.get(d.amount - s, []) if a + b), len(pool)

    want = {(d.entity, d.bank_index): closings(d) for d in decided}
    assert max(n for _, n in want.values()) <= 42
    got: dict = {}
    for r in resolution.c1_row_subsets(spark, SF).collect():
        got.setdefault((r.entity, r.bank_index), []).extend([r.row_ids] if r.row_ids else [])
        assert r.complete
    assert {k: sorted(v) for k, v in got.items()} == {(d.entity, d.bank_index): want[d.entity, d.bank_index][0] for d in decided if d.kind is None}
    rivals = {(r.entity, r.bank_index): (r.rivals, r.lower_bound) for r in resolution.r7_rival_closures(spark, SF).collect()}
    assert rivals == {(d.entity, d.bank_index): (max(1, len(want[d.entity, d.bank_index][0])), False) for d in decided if d.kind == "verified"}
    outcomes = {(r.entity, r.bank_index): (r.kind, r.n_candidates) for r in resolver.resolve(ledger, fixtures.bank(ledger), fixtures.report(ledger)).collect()}
    for d in decided:
        if d.kind is None:
            n = len(want[d.entity, d.bank_index][0])
            assert outcomes[d.entity, d.bank_index][1] == n and (n < 2 or outcomes[d.entity, d.bank_index][0] == "ambiguous")


def test_cascade_third_stage_line_by_line(spark):
    """Each entity's lines one after another in memory, with the rows that earlier lines consumed."""
    from tallyloom.operators import cascade

    day, hour = 86_400, 3_600
    rows, lines, matched = [], [], []

    def row(entity, name, credit, at, settlement=None, debit=0, kind="payment", hold=False, fee=0):
        rows.append((entity, name, kind, None, f"o-{name}", credit, debit, credit or debit, fee, 0, hold, (10_000 + at) * day + 6 * hour, None, settlement, "card", None))

    for entity in range(1, 41):
        r = __import__("random").Random(entity)
        for k in range(r.randrange(4, 9)):
            row(entity, f"p{entity}_{k}", r.choice((5, 7, 11, 13, 20)), r.randrange(0, 12), settlement=f"s{entity}_{k % 2}" if k < 4 else None, hold=r.random() < 0.1)
        if entity % 2:
            row(entity, f"d{entity}", 0, r.randrange(0, 9), debit=r.choice((2, 3)), kind="refund")
        for k in range(5):
            lines.append((entity * 100 + k, entity, "", 10_000 + 9 + r.randrange(0, 9), r.choice((5, 7, 9, 12, 13, 18, 20, 25, -7))))
        matched.append((entity, entity * 100 + r.randrange(5), f"s{entity}_0"))
    ledger = spark.createDataFrame(rows, fixtures.ledger(spark, SF).schema)
    bank = spark.createDataFrame(lines, "bank_index long, entity long, reference string, value_day long, amount long")
    known = spark.createDataFrame(matched, "entity long, bank_index long, settlement_id string")
    decided, named = cascade.reconstructed(ledger, bank, known)
    got = {(r.entity, r.bank_index): (r.verdict, r.n_candidates, r.deferred) for r in decided.collect()}
    got_rows = {(r.bank_index, r.row_id): r.certain for r in named.collect()}
    want, want_rows = {}, {}
    for entity in range(1, 41):
        consumed = set()
        for index, _, _, value_day, amount in sorted((x for x in lines if x[1] == entity), key=lambda x: (x[3], x[0])):
            pool = {}
            for x in rows:
                local = (x[11] + 19_800) // day
                start = local + ({4: 4, 5: 4, 6: 3}.get((local + 4) % 7, 2) if x[2] == "payment" else 0)
                if x[0] == entity and not x[10] and x[1] not in consumed and start <= value_day:
                    pool[x[1]] = x[5] - x[6]
            every = [c for n in range(1, len(pool) + 1) for c in itertools.combinations(sorted(pool), n) if sum(pool[i] for i in c) == amount]
            debits = lambda c: sum(i[0] == "d" for i in c)
            best = [c for c in every if debits(c) == max(map(debits, every))]
            there = sum(i[0] == "d" for i in pool)
            verdict = "unresolved" if not best else "ambiguous" if len(best) > 1 else "determinate"
            want[entity, index] = (verdict, len(best), there - (debits(best[0]) if best else 0))
            want_rows |= {(index, i): all(i in c for c in best) for c in best for i in c}
            if (entity, index) in {(e, b) for e, b, _ in matched}:
                consumed |= {x[1] for x in rows if x[0] == entity and x[13] == f"s{entity}_0"}
            elif verdict == "determinate":
                consumed |= set(best[0])
    assert {v for v, *_ in want.values()} == {"unresolved", "ambiguous", "determinate"}
    assert got == want and got_rows == want_rows


@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(0, 120))
@settings(max_examples=100, deadline=None)
def test_largest_under_cap(nets, cap):
    ids = [f"r{k}" for k in range(len(nets))]
    best, found, proven = subsets.largest_under_cap(ids, nets, cap)
    assert proven
    sums = [sum(c) for n in range(len(nets) + 1) for c in itertools.combinations(nets, n)]
    assert best == max(s for s in sums if s <= cap)
    assert all(sum(nets[int(i[1:])] for i in c) == best for c in found)


@given(st.integers(0, 4000), st.integers(1, 12))
@settings(max_examples=12, deadline=None)
def test_working_days(spark, day, n):
    at, left = date(1970, 1, 1) + timedelta(day), n
    while left:
        at += timedelta(1)
        left -= at.weekday() < 5
    got = spark.range(1).select(calendar.add_working_days(F.lit(day).cast("long"), n), calendar.two_working_days(F.lit(day).cast("long"))).first()
    assert date(1970, 1, 1) + timedelta(got[0]) == at
    if n == 2:
        assert got[0] == got[1]


def test_money(spark):
    good = spark.createDataFrame([("1.5", 150), ("-0.05", -5), ("12345.67", 1234567), (None, None)], "t string, p long")
    assert all(r.p == r.x and (r.p is None or r.p == money_back(r.s)) for r in good.select("p", money.paise(F.col("t")).alias("x"), money.rupees(F.col("p")).alias("s")).collect())
    for bad in ("1.234", "1,000", "+5", ".5", ""):
        assert spark.createDataFrame([(bad,)], "t string").select(money.try_paise(F.col("t"))).first()[0] is None
        with pytest.raises(Exception, match="not a rupee amount"):
            spark.createDataFrame([(bad,)], "t string").select(money.paise(F.col("t"))).collect()


def money_back(s: str) -> int:
    whole, _, part = s.lstrip("-").partition(".")
    return (-1 if s.startswith("-") else 1) * (int(whole) * 100 + int(part))


def test_similarity():
    assert text.token_set_similarity("new york mets", "mets york new") == 100
    assert text.token_set_similarity("abc", "xyz") == 0
    assert text.similarity("kitten", "sitting") == pytest.approx(200 * 4 / 13)


@given(st.lists(st.tuples(st.text("ab é\U0001d11e", max_size=90), st.text("ab é\U0001d11e", max_size=150)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_similarities_of_many_pairs(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert list(text.ratios(a, b)) == [text.similarity(x, y) for x, y in pairs]
    assert list(text.token_set_ratios(a, b)) == [text.token_set_similarity(x, y) for x, y in pairs]


def test_similarities_in_small_blocks(monkeypatch):
    monkeypatch.setattr(text, "CELLS", 300)
    a, b = ["abc" * k for k in range(1, 60)], ["bca" * (60 - k) + "é" for k in range(1, 60)]
    assert list(text.ratios(a, b)) == [text.similarity(x, y) for x, y in zip(a, b, strict=True)]


def test_gap_candidates(spark):
    without = spark.createDataFrame([(1, "r", "order_17", 10_000, 100), (1, "s", None, 10_000, 100), (2, "t", "order_17", 10_000, 100)], "entity long, row_id string, order_id string, amount long, day long")
    orphans = spark.createDataFrame([(1, "order_71", 10_150, 97), (1, "far", 10_201, 100), (1, "late", 10_000, 104)], "entity long, order_id string, amount long, invoice_day long")
    got = {r.row_id: (r.order_id, r.amount_gap, r.day_gap, r.similarity) for r in joins.erp_gap_candidates(without, orphans).collect()}
    assert got == {"r": ("order_71", 150, 3, 87.5), "s": ("order_71", 150, 3, None)}


@given(st.integers(1, 5), st.integers(1, 5), st.data())
@settings(max_examples=60, deadline=None)
def test_assignment(n, m, data):
    costs = [[data.draw(st.integers(0, 30)) for _ in range(m)] for _ in range(n)]
    got = audit.assigned_pairs(costs)
    k = min(n, m)
    best = min(sum(costs[i][j] for i, j in zip(rows, columns, strict=True)) for rows in itertools.permutations(range(n), k) for columns in itertools.combinations(range(m), k))
    assert len(got) == k and sum(c for *_, c, _ in got) == best


def test_hypergeometric_tail():
    assert audit.hypergeometric_tail(0, 3, 2, 10) == 1
    assert audit.hypergeometric_tail(2, 3, 2, 10) == pytest.approx(8 / 120)


DAY = 86_400


def book(spark, rows, lines, report):
    cols = "entity long, row_id string, type string, payment_id string, credit long, debit long, amount long, fee long, tax long, on_hold boolean, created_at long, settled_at long, settlement_id string, order_id string, method string, dispute_id string"
    full = [(1, r, "payment", None, net, 0, net, 1, 1, False, made * DAY, None, s, None, "card", None) for r, net, made, s in rows]
    return (
        spark.createDataFrame(full, cols), spark.createDataFrame([(1, *x) for x in lines], "entity long, bank_index long, reference string, value_day long, amount long"),
        spark.createDataFrame([(1, *x) for x in report], "entity long, settlement_id string, reported_reference string, reported_amount long, file_position long"))


def test_resolver_golden_cases(spark):
    rows = [("a1", 60, 10, "A"), ("a2", 40, 10, "A"), ("b1", 70, 10, "B"), ("c1", 70, 10, "C"), ("d1", 55, 10, "D"), ("e1", 31, 99, "E"), ("f1", 17, 10, None), ("g1", 25, 10, "G"), ("h1", 33, 10, "H")]
    lines = [
        (0, "ra", 20, 100), (1, "ra", 21, 100), (2, "", 20, 70), (3, "rd", 20, 54), (4, "re", 20, 31), (5, "", 20, 17), (6, "rg", 20, 26), (7, "x", 20, 500), (8, "x", 22, -500),
        (9, "y", 20, -3), (10, "", 20, 33), (11, "z", 20, 9_999)]
    report = [("A", "ra", 100, 0), ("D", "rd", 54, 1), ("E", "re", 31, 2), ("G", "rg", 25, 3)]
    out = {r.bank_index: (r.kind, r.reason) for r in resolver.resolve(*book(spark, rows, lines, report)).collect()}
    assert out == {
        0: ("verified", None), 1: ("discrepancy", "DOUBLE_ASSIGNMENT"), 2: ("ambiguous", None), 3: ("discrepancy", "ATTESTED_COMPOSITION_DOES_NOT_CLOSE"),
        4: ("discrepancy", "TEMPORAL_IMPOSSIBILITY"), 5: ("reconstructed", None), 6: ("discrepancy", "CLAIMED_CREDIT_NOT_ON_STATEMENT"), 7: ("discrepancy", "CREDIT_REVERSED"),
        8: ("unresolved", "OTHER"), 9: ("unresolved", "NOT_OUR_CREDIT"), 10: ("verified", None), 11: ("unresolved", "NO_SUBSET_CLOSES")}


def test_reconstructions_that_share_a_row_are_withdrawn(spark):
    rows = [("a", 10, 10, None), ("b", 7, 10, None), ("c", 5, 10, None)]
    out = resolver.resolve(*book(spark, rows, [(0, "", 20, 17), (1, "", 20, 15)], [])).collect()
    assert {(r.bank_index, r.kind, r.reason) for r in out} == {(0, "unresolved", "OTHER"), (1, "unresolved", "OTHER")}


def test_reversals_queue(spark):
    lines = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 1, 5), (1, 2, 7, -5), (1, 3, 8, -5), (1, 4, 30, -5)], "entity long, bank_index long, value_day long, amount long")
    assert {(r.credit_index, r.debit_index) for r in joins.reversals(lines).collect()} == {(0, 2), (1, 3)}


LINES = [("utr1", date(2024, 2, 29), "first", 12_345), ("", date(2024, 3, 1), "second <&>", -5), ("utr3", date(2024, 3, 2), "", 100)]


@pytest.mark.parametrize("kind", statements.PARSERS)
def test_statement_round_trip(spark, tmp_path, kind):
    (tmp_path / f"s.{kind}").write_bytes({"camt053": statements.to_camt053, "mt940": statements.to_mt940, "xlsx": statements.to_xlsx}[kind](LINES))
    out = statements.read_statements(spark, str(tmp_path), kind).orderBy("bank_index").collect()
    assert [(r.reference, r.value_date, r.narration, r.amount) for r in out] == LINES


def test_malformed_statements():
    with pytest.raises(ValueError, match="DOCTYPE"):
        list(statements.camt053(b"<!DOCTYPE x><Document/>"))
    with pytest.raises(ValueError, match="statement line"):
        list(statements.mt940(b":61:oops"))
    with pytest.raises(ValueError, match="header"):
        list(statements.xlsx(_sheet_without_header()))


def test_statement_lines():
    line = statements.statement_line
    assert line(":61:2401050106CR12,5NTRFINV/2024/7//BANKREF") == ("INV/2024/7", date(2024, 1, 5), 1250)
    assert line(":61:991231RD1000,00103E ref //x//y") == ("ref", date(1999, 12, 31), -100_000)
    assert line(":61:240105D7,S123") == ("", date(2024, 1, 5), -700)
    for bad in (":61:24010", ":61:240105X1,NTRF", ":61:240105C1NTRF", ":61:240105C1,234NTRF", ":61:240105C1,NTR"):
        with pytest.raises(ValueError, match="statement line"):
            line(bad)


def _sheet_without_header() -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book_:
        book_.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c r='A1'><v>1</v></c></row></sheetData></worksheet>")
    return out.getvalue()


def test_directory(spark, tmp_path):
    (tmp_path / files.LEDGER).write_text(json.dumps({"entity": "collection", "count": 1, "items": [{"entity_id": "pay_1", "type": "payment", "credit": 10, "debit": 0, "amount": 12, "fee": 1, "tax": 1, "settlement_id": None, "notes": {}}]}))
    (tmp_path / files.BANK).write_text("utr,date,narration,amount\nx,2024-01-02,hello,-1.50\n,2024-01-03,,2\n")
    (tmp_path / files.DISPUTES).write_text(json.dumps([{"dispute_id": "d1", "phase": "open"}]))
    found = files.load(spark, str(tmp_path))
    assert set(found) == {"recon_combined", "bank_statement", "disputes"}
    assert [(r.bank_index, r.reference, r.amount) for r in found["bank_statement"].orderBy("bank_index").collect()] == [(0, "x", -150), (1, "", 200)]
    assert found["disputes"].first().id == "d1" and found["recon_combined"].first().entity_id == "pay_1"
    assert files.ledger(spark, f"{tmp_path}/{files.LEDGER}")[1] is True
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path), strict=True)
    with pytest.raises(ValueError, match="answer key"):
        files.load(spark, f"{tmp_path}/ground_truth.json")
    with pytest.raises(ValueError, match="several"):
        files.resolve_roles(["utr", "bank_reference", "date", "narration", "amount"], files.BANK_ROLES)
    (tmp_path / files.DISPUTES).write_text(json.dumps({"items": [{"id": "d1"}, {"id": "d1"}]}))
    with pytest.raises(Exception, match="repeated"):
        files.disputes(spark, f"{tmp_path}/{files.DISPUTES}").collect()
    (tmp_path / files.BANK).write_text("utr,date,narration,amount\n")
    with pytest.raises(ValueError, match="no lines"):
        files.bank_statement(spark, f"{tmp_path}/{files.BANK}")


def test_items_and_pages(spark, tmp_path):
    for name, body in (("a", '[{"x": 1}, {"x": 2}]'), ("b", '{"x": 1}\n{"x": 2}\n'), ("c", '{"items": [{"x": 1}, {"x": 2}]}')):
        (tmp_path / name).write_text(body)
        assert [json.loads(r.item) for r in files.items(spark, str(tmp_path / name)).orderBy("n").collect()] == [{"x": 1}, {"x": 2}]
    pages = spark.createDataFrame([(1, ["a"], True), (2, ["b", "c"], False)], "page int, items array<string>, has_more boolean")
    assert [r.item for r in files.merged_pages(pages).orderBy("page", "n").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="out of order"):
        files.merged_pages(pages.withColumn("has_more", F.lit(False))).collect()
    assert files.artefact_of({"utr", "date", "narration", "amount"}) == files.BANK and files.artefact_of({"x"}) is None
    assert files.manifest_gaps({files.BANK, "other"})[1] == {"other"}


def test_positions_over_splits(spark, tmp_path):
    """Rows keep their place in files that are read in many splits."""
    for name, n in (("a.csv", 700), ("b.csv", 30)):
        (tmp_path / name).write_text("x\n" + "".join(f"{name}-{k:05}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        out = files.in_file_order(spark.read.option("header", True).csv(str(tmp_path)), "at").orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.x, r.at) for r in out] == [(x, k) for k, x in enumerate([f"a.csv-{k:05}" for k in range(700)] + [f"b.csv-{k:05}" for k in range(30)])]


def test_feeds_in_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"entity_id": f"pay_{k}", "type": "payment", "credit": k}) for k in range(5)))
    rows, has = files.ledger(spark, f"{tmp_path}/l.json")
    assert sorted((r.entity_id, r.credit) for r in rows.collect()) == [(f"pay_{k}", k) for k in range(5)] and not has
    with pytest.raises(ValueError, match="answer key"):
        files.items(spark, f"{tmp_path}/{files.ANSWER_KEY}")


def test_replay_and_exact_files(spark, tmp_path):
    import hashlib

    (tmp_path / "f1").write_bytes(b"one")
    record = {"key": "k1", "path": f"{tmp_path}/f1", "sha256": hashlib.sha256(b"one").hexdigest()}
    (tmp_path / "rec.json").write_text(json.dumps(record))
    assert [(r.key, bytes(r.content)) for r in files.replayed(spark, f"{tmp_path}/rec.json").collect()] == [("k1", b"one")]
    (tmp_path / "f1").write_bytes(b"two")
    with pytest.raises(Exception, match="not as recorded"):
        files.replayed(spark, f"{tmp_path}/rec.json").collect()
    table = spark.createDataFrame([(2, "b", "x"), (1, "a", "y")], "n int, t string, more string")
    for name in ("one", "two"):
        files.write_exact(table.repartition(2), f"{tmp_path}/{name}", ["t", "n"], ["n"])
        (part,) = (tmp_path / name).glob("part-*.csv")
        assert part.read_text() == "t,n\na,1\nb,2\n"


def test_greedy_tolerance_line_by_line(spark):
    r = __import__("random").Random(5)
    near = sorted({(e, r.randrange(9), f"s{r.randrange(7)}") for e in range(12) for _ in range(r.randrange(2, 16))})
    got = {(x.entity, x.bank_index, x.settlement_id) for x in joins.greedy_matches(spark.createDataFrame(near, "entity long, bank_index long, settlement_id string")).collect()}
    want, used = set(), set()
    for entity, line in sorted({(e, b) for e, b, _ in near}):
        left = [s for e, b, s in near if (e, b) == (entity, line) and (e, s) not in used]
        if len(left) == 1:
            want.add((entity, line, left[0]))
            used.add((entity, left[0]))
    assert got == want and len(want) > 5
    assert joins.greedy_matches(spark.createDataFrame([], "entity long, bank_index long, settlement_id string")).count() == 0


def test_residual_pairs_say_what_isnt_searched(spark):
    from tallyloom.operators import cascade

    a = spark.createDataFrame([(1, "p1", 100, 5), (1, "p2", 900, 5), (2, "q1", 1, 1), *((3, f"r{k}", 1, 1) for k in range(6))], "entity long, row_id string, amount long, day long")
    b = spark.createDataFrame([(1, "o1", 110, 5), (3, "o3", 1, 1)], "entity long, order_id string, amount long, invoice_day long")
    out = {r.row_id: (r.order_id, r.cost, r.status) for r in cascade.residual_pairs(a, b, limit=1_000_100, most=5, most_edges=5).collect()}
    assert out == {"p1": ("o1", 1_000_010, "paired"), "p2": (None, None, "unpaired"), "q1": (None, None, "unpaired")} | {f"r{k}": (None, None, "not_searched") for k in range(6)}


def test_residual_pairs_by_cluster(spark):
    """A large entity: what is accepted costs as much as the cheapest pairing of all whose pairs can be accepted."""
    rng = random.Random(12)
    left = [(1, f"p{k:03}", rng.randrange(0, 60_000), rng.randrange(0, 60)) for k in range(120)]
    right = [(1, f"o{k:03}", rng.randrange(0, 60_000), rng.randrange(0, 60)) for k in range(110)]
    limit = 1_000_000 + 4_000
    a, b = spark.createDataFrame(left, "entity long, row_id string, amount long, day long"), spark.createDataFrame(right, "entity long, order_id string, amount long, invoice_day long")
    out = cascade.residual_pairs(a, b, limit=limit, most=60).collect()
    assert sorted(r.row_id for r in out) == [x[1] for x in left] and "not_searched" not in {r.status for r in out}
    paired = [r for r in out if r.status == "paired"]
    orders = [r.order_id for r in paired]
    assert len(set(orders)) == len(orders) > 10
    cost = lambda x, y: abs(x[2] - y[2]) + 1_000 * abs(x[3] - y[3]) + 1_000_000
    at = {x[1]: x for x in left + right}
    assert all(r.cost == cost(at[r.row_id], at[r.order_id]) <= limit for r in paired)
    # all pairs at once, with places of their own at the cost of the limit
    far = 10**12
    whole = audit.assigned_pairs([[c if (c := cost(x, y)) <= limit else far for y in right] + [limit if k == i else far for k in range(len(left))] for i, x in enumerate(left)], limit)
    assert sum(r.cost for r in paired) + limit * (len(left) - len(paired)) == sum(c for *_, c, _ in whole)
    assert {r.status for r in cascade.residual_pairs(a, b, limit=limit, most=60, most_edges=5).collect()} == {"not_searched"}
    assert {r.status for r in cascade.residual_pairs(a, b, most=60).collect()} == {"unpaired"}  # nothing can be accepted


def test_residual_pairs_of_payments_that_name_an_order(spark):
    """Columns beside those that are compared, the payment's own order id among them, change nothing."""
    from tallyloom.operators import cascade

    a = spark.createDataFrame([(1, "p1", "x1", 100, 5), (1, "p2", "x2", 900, 5), (2, "q1", "x1", 1, 1)], "entity long, row_id string, order_id string, amount long, day long")
    b = spark.createDataFrame([(1, "o1", 110, 5, 9)], "entity long, order_id string, amount long, invoice_day long, day long")
    for most in (1, 200):  # by acceptable pairs, all at once
        out = {r.row_id: (r.order_id, r.cost, r.status) for r in cascade.residual_pairs(a, b, limit=1_000_100, most=most).collect()}
        assert out == {"p1": ("o1", 1_000_010, "paired"), "p2": (None, None, "unpaired"), "q1": (None, None, "unpaired")}


def test_residual_pairs_of_a_large_entity(spark):
    """Size drops nothing: refused pairs are there, pairs that can be accepted are searched however many, and the pairing is the cheapest."""
    rng = random.Random(6)
    left = [(1, f"p{k:03}", rng.randrange(0, 60_000), rng.randrange(0, 60)) for k in range(260)] + [(2, f"q{k:03}", 500, 5) for k in range(330)] + [(3, "r", 1, None)]
    right = [(1, f"o{k:03}", rng.randrange(0, 60_000), rng.randrange(0, 60)) for k in range(240)] + [(2, f"s{k:03}", 500, 5) for k in range(320)] + [(3, "t", 1, 1)]
    a, b = spark.createDataFrame(left, "entity long, row_id string, amount long, day long"), spark.createDataFrame(right, "entity long, order_id string, amount long, invoice_day long")
    cost = lambda x, y: abs(x[2] - y[2]) + 1_000 * abs(x[3] - y[3]) + 1_000_000
    of = lambda side, entity: [x for x in side if x[0] == entity]
    for limit in (10_000, 1_001_000):
        out = cascade.residual_pairs(a, b, limit=limit).collect()
        assert sorted(r.row_id for r in out) == sorted(x[1] for x in left)
        pairs, at = [r for r in out if r.order_id], {x[1]: x for x in left + right}
        assert len({r.order_id for r in pairs}) == len(pairs) and all(r.cost == cost(at[r.row_id], at[r.order_id]) and r.status == ("paired" if r.cost <= limit else "refused") for r in pairs)
        assert Counter((r.entity, r.status) for r in out if not r.order_id) == {(1, "unpaired"): 20, (2, "unpaired"): 10, (3, "unpaired"): 1}
        assert sum(r.cost for r in pairs if r.entity == 1) == sum(c for *_, c, _ in audit.assigned_pairs([[cost(x, y) for y in of(right, 1)] for x in of(left, 1)]))
        assert sum(r.cost for r in pairs if r.entity == 2) == 320 * 1_000_000


_POINTS = st.integers(1, 12).flatmap(lambda most: st.lists(st.tuples(st.integers(-most, most), st.integers(-most, most)), min_size=1, max_size=12))


@given(_POINTS, _POINTS)
@settings(max_examples=200, deadline=None)
def test_nearest_pairs(left, right):
    costs = [[abs(x - y) + abs(d - e) for y, e in right] for x, d in left]
    i, j = audit.nearest_pairs(tuple(zip(*left, strict=True)), tuple(zip(*right, strict=True)))
    assert len(set(i.tolist())) == len(set(j.tolist())) == len(i) == min(len(left), len(right))
    assert sum(costs[x][y] for x, y in zip(i, j, strict=True)) == sum(c for *_, c, _ in audit.assigned_pairs(costs))


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 30)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_cheapest_pairs(edges):
    limit, near = 15, {}
    for i, j, c in edges:
        near[i, j] = min(c, near.get((i, j), c))
    left, right = sorted({i for i, _ in near}), sorted({j for _, j in near})
    got = audit.cheapest_pairs(edges, limit)
    assert len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got) and all(near[i, j] == c for i, j, c in got)
    far = 10**6
    costs = [[near.get((i, j), far) for j in right] + [limit if k == i else far for k in left] for i in left]
    assert sum(c for *_, c in got) + limit * (len(left) - len(got)) == sum(c for *_, c, _ in audit.assigned_pairs(costs))


def test_upserted_history(spark, tmp_path):
    """Equal to the merge of the whole table after each run; a run writes just the buckets that it touches, and twice nothing."""
    rng = random.Random(2)
    path, want = f"{tmp_path}/history", spark.createDataFrame([], "row_id string, entity long, first_seq long, last_seq long, closed_seq long")
    rows = {e: [f"{e}-{k}" for k in range(60)] for e in (1, 2)}
    for seq in range(1, 6):
        for e in (1, 2):
            seen = spark.createDataFrame([(i,) for i in (rng.sample(rows[e], 40) if e == 1 or seq < 3 else rows[e][:2])], "row_id string")
            changed = store.upsert_history(path, seen, e, seq, 16)
            want = spark.createDataFrame(store.merged_history(want, seen, e, seq).collect(), want.schema)
            got = store.stored_history(spark, path)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
            assert store.upsert_history(path, seen, e, seq, 16) == []
            if e == 2 and seq > 3:  # two rows are open
                assert len(changed) <= 2


def test_every_breach_is_found(spark):
    """A row for each invariant of the contract that breaks it alone, and a clean set that breaks none."""
    frames = {
        "outcomes": ("entity long, bank_index long, tier string, kind string, reason string, settlement_id string", [(1, 1, "A", "verified", None, "s1"), (1, 2, "C", "ambiguous", None, None), (1, 3, "C", "reconstructed", None, None), (1, 4, "A", "discrepancy", "CREDIT_REVERSED", "s4")]),
        "found": ("entity long, bank_index long, source string, party string", [(1, 1, "bank", "bank"), (1, 1, "ledger", "psp"), (1, 1, "settlement_report", "psp"), (1, 3, "ledger", "psp")]),
        "assigned": ("entity long, bank_index long, row_id string", [(1, 1, "r1")]),
        "composed": ("entity long, bank_index long, credit_ids array<string>, debit_ids array<string>", [(1, 1, ["r1", "r2"], ["r3"])]),
        "dispositions": ("entity long, row_id string, proven string, reason string, caused_by long, provable boolean", [(1, "r8", None, "unexplained", None, False), (1, "r9", "NETTED_OUT", None, None, None), (1, "r7", None, "timing_difference", None, True)]),
        "candidates": ("entity long, bank_index long, n int, complete boolean", [(1, 2, 3, False), (1, 3, 1, True)]),
        "rivals": ("entity long, bank_index long, rivals long", [(1, 1, 1)]),
        "flagged": ("entity long, row_id string, ground string", [(1, "r8", "gstr2b_absent")]),
    }
    breaks = {
        "evidence names a source": ("found", (1, 1, "", "psp")), "an attestation is the processor's": ("found", (1, 1, "settlement_report", "bank")), "a bank reference is the bank's": ("found", (1, 1, "bank", "psp")),
        "a discrepancy says what contradicts": ("outcomes", (1, 9, "A", "discrepancy", None, "s")), "a row is on one side of a composition": ("composed", (1, 5, ["x"], ["x"])), "a composition is sorted": ("composed", (1, 5, ["y", "x"], [])),
        "ambiguous has two candidates": ("outcomes", (1, 9, "C", "ambiguous", None, None)), "reconstructed is unique and complete": ("outcomes", (1, 9, "C", "reconstructed", None, None)), "a line has one outcome": ("outcomes", (1, 4, "A", "discrepancy", "CREDIT_REVERSED", "s4")),
        "a row settles once": ("assigned", (1, 2, "r1")), "a row has one disposition": ("dispositions", (1, "r8", None, "unexplained", None, False)), "an assigned row has no disposition": ("assigned", (1, 1, "r8")),
        "a cause and its reason stand together": ("dispositions", (1, "r5", None, "upstream_unresolved", None, False)), "only timing is provable": ("dispositions", (1, "r5", None, "unexplained", None, True)), "a tax flag is on an open break": ("flagged", (1, "r0", "gstr2b_absent")),
        "a tax flag has its ground": ("flagged", (1, "r8", None)), "reconstructed has fewer than two parties": ("found", (1, 3, "bank", "bank")),
    }
    made = lambda changed=None, row=None: {k: spark.createDataFrame(rows + ([row] if k == changed else []), schema) for k, (schema, rows) in frames.items()}
    assert gates.contract_breaches(**made()).collect() == []
    for invariant, (frame, row) in breaks.items():
        assert {r.invariant for r in gates.contract_breaches(**made(frame, row)).collect()} == {invariant}
    bare = made("outcomes", (1, 9, "A", "verified", "X", "s9"))
    assert {r.invariant for r in gates.contract_breaches(**bare).collect()} == {
        "a warrant has evidence", "verified names a composition", "verified confirms a consequence", "verified has two parties", "verified carries no contradiction", "verified counts its rivals"}


def test_hypergeometric_tails():
    """All tables of up to 12, exactly; large ones in a time that doesn't grow with the members, and to ten digits."""
    import math
    import time

    import numpy as np

    for total in range(1, 13):
        for members, n in itertools.product(range(total + 1), repeat=2):
            hits = np.arange(n + 2)
            want = [sum(math.comb(members, i) * math.comb(total - members, n - i) for i in range(h, min(n, members) + 1)) / math.comb(total, n) for h in hits]
            assert audit.hypergeometric_tails(hits, np.full(len(hits), n), members, total) == pytest.approx(want, rel=1e-11, abs=0)
    for h, n, members, total in ((150, 700, 200, 1_000), (130, 700, 200, 1_000), (40, 90, 300, 1_000)):
        want = sum(math.comb(members, i) * math.comb(total - members, n - i) for i in range(h, min(n, members) + 1)) / math.comb(total, n)
        assert audit.hypergeometric_tail(h, n, members, total) == pytest.approx(want, rel=1e-11, abs=0)
    began, drawn = time.process_time(), np.arange(1_000, 5_000_000, 250)
    p = audit.hypergeometric_tails(drawn // 6, drawn, 1_600_000, 10_000_000)  # before: up to 1.6 million terms for each of these
    assert time.process_time() - began < 20 and ((p >= 0) & (p <= 1)).all()


def test_predicates_and_class_audits(spark):
    import math

    rows = [(k, "card" if k % 2 else "upi", 100 + k, k >= 90, '{"desk": "7"}' if k >= 88 else "[]") for k in range(100)]
    df = spark.createDataFrame(rows, "k long, method string, amount long, late boolean, notes string")
    t = {(r.column, r.predicate): r for r in audit.scored(audit.predicates(df, "late", ["method", "amount"], notes="notes"), 10, 100).collect()}
    assert (t["amount", ">= 190"].support, t["amount", ">= 190"].hits) == (10, 10) and t["amount", ">= 190"].leaks and t["amount", ">= 190"].lift_bp == 100_000
    assert (t["notes", "desk = 7"].support, t["notes", "desk = 7"].hits) == (12, 10) and not t["notes", "desk = 7"].leaks  # precision 0.83
    assert (t["notes", "without desk"].support, t["notes", "without desk"].hits) == (88, 0) and (t["method", "= card"].support, t["method", "= card"].hits) == (50, 5)
    exact = lambda h, n: sum(math.comb(10, i) * math.comb(90, n - i) for i in range(h, min(10, n) + 1)) / math.comb(100, n)
    for r in t.values():
        assert r.p_value == pytest.approx(exact(r.hits, r.support), rel=1e-9)
    audits = {r["class"]: r for r in audit.class_audits(df, {"late": "late", "two": "k < 2", "most": "k < 80"}, ["method", "amount"], notes="notes").collect()}
    assert (audits["late"].state, audits["late"].best) == ("tested", "amount >= 190") and audits["late"].n_leaks > 0
    assert audits["two"].state == "untestable" and audits["most"].state == "degenerate"


def test_conjunctions_of_the_best_predicates(spark):
    rng = random.Random(5)
    notes = [None, "[]", "{}", '{"desk": "7"}', '{"desk": "8", "via": "x = y"}']
    rows = [(k, rng.choice(["card", "upi", None]), rng.choice([None, 5, 7, 9, 11, 13]), rng.choice(["late fee", "fee_paid", None]), rng.choice(notes), rng.choice([True, False, False, None])) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, method string, amount long, text string, notes string, m boolean").repartition(5)
    got = {tuple(r)[:4]: (r.support, r.hits) for r in audit.best_pairs(df, "m", ["method", "amount", "text"], notes="notes", best=4).collect()}
    note = lambda r: json.loads(r[4]) if (r[4] or "").startswith("{") else None

    def holds(column, p, r):
        v = r[{"method": 1, "amount": 2, "text": 3, "notes": 4}[column]]
        if column == "notes" and not p.startswith("is "):
            d = note(r) or {}
            return p[5:] in d if p.startswith("with ") else p[8:] not in d if p.startswith("without ") else any(f"{x} = {y}" == p for x, y in d.items())
        if p.startswith("is "):
            return (v is None) == (p == "is null")
        if v is None:
            return False
        return {"=": lambda: str(v) == p[2:], "<=": lambda: v <= int(p[3:]), ">=": lambda: v >= int(p[3:]), "contains": lambda: p[9:] in v.replace("_", " ").split()}[p.split()[0]]()

    found = audit.predicates(df, "m", ["method", "amount", "text"], notes="notes").collect()
    best = {}
    for column in ("method", "amount", "text", "notes"):
        own = [r for r in found if r.column == column and 0 < r.support < 150]
        best[column] = sorted(own, key=lambda r: (-r.hits / r.support, -r.hits, r.predicate))[:4]
    want = {}
    for a, b in itertools.combinations(sorted(best), 2):
        for p, q in itertools.product(best[a], best[b]):
            both = [r for r in rows if holds(a, p.predicate, r) and holds(b, q.predicate, r)]
            if any(r[5] for r in both) and len(both) < 150:
                want[a, p.predicate, b, q.predicate] = (len(both), sum(bool(r[5]) for r in both))
    assert got == want and len(got) > 30
    empty = df.where("k < 0")
    assert audit.best_pairs(empty, "m", ["method"]).count() == 0 and audit.conjunctions(df, "m", []).count() == 0


def test_recoverable_values(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    rows = [(word(rng.randrange(3, 9)), word(6), None if k % 3 else word(12)) for k in range(60)]
    references = [word(rng.randrange(0, 20)) for _ in range(25)] + [rows[0][2] + "x", None]
    got = {r.column: (r.n_found, r.recoverable) for r in audit.recoverable_columns(spark.createDataFrame(rows, "a string, b string, c string"), spark.createDataFrame([(r,) for r in references], "reference string"), ["a", "b", "c"]).collect()}
    want = {}
    for k, c in enumerate("abc"):
        n = len({r[k] for r in rows if r[k] and len(r[k]) >= 6 and any(t and r[k] in t for t in references)})
        if n:
            want[c] = (n, n >= 2)
    assert got == want and want["b"][0] > 2 and "c" in want
    assert audit.recoverable_columns(spark.createDataFrame([("abc",)], "a string"), spark.createDataFrame([], "reference string"), ["a"]).count() == 0


def test_underpowered_classes(spark):
    df = spark.range(12).select(F.col("id").alias("amount"), (F.col("id") % 3).cast("string").alias("kind"), (F.col("id") >= 9).alias("late"))
    few = audit.class_audits(df, {"late": "late"}, ["amount", "kind"]).first()  # 3 of 12: no test tells it from chance
    assert (few.state, few.n_leaks > 0, few.n_certified, few.best) == ("underpowered", True, 0, "amount >= 9")
    more = spark.range(240).select(F.col("id").alias("amount"), (F.col("id") % 3).cast("string").alias("kind"), (F.col("id") >= 234).alias("late"))
    row = audit.class_audits(more, {"late": "late"}, ["amount", "kind"]).first()
    assert (row.state, row.best) == ("tested", "amount >= 234") and row.n_certified > 0


def test_similarity_columns(spark):
    pairs = spark.createDataFrame([("setl 1 1993", "utr 1 1993"), ("", ""), (None, "x"), ("a b", "b a")], "a string, b string")
    out = pairs.select("a", "b", text.similarities()("a", "b").alias("s"), text.similarities("ratio")("a", "b").alias("r")).toPandas()
    for a, b, s, r in out.itertuples(index=False):
        assert (s != s and r != r) if a is None else (s, r) == (text.token_set_similarity(a, b), text.similarity(a, b))


def test_stored_runs(spark, tmp_path):
    out = spark.createDataFrame([(1, 10, "verified", None), (1, 20, "open", None)], "entity long, bank_index long, kind string, reason string")
    path = f"{tmp_path}/store"
    store.write_run(out, F.lit("run1"), path)
    store.write_run(out.where("bank_index = 10"), F.lit("run2"), path)
    store.write_run(out, F.lit("run1"), path)  # once more: nothing changes
    assert store.stored_run(spark, path, "run1").count() == 2 and store.stored_run(spark, path, "run2").count() == 1
    packed = store.encoded(out, F.lit("Verified"))
    back = store.decoded(packed, "entity long, bank_index long, kind string, reason string")
    assert sorted(map(tuple, back.drop("__type__").collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        store.decoded(spark.createDataFrame([("nonsense",)], "outcome string"), "kind string").collect()
    names = spark.createDataFrame([("b", 2), ("A", 10), (None, 1)], "t string, n long")
    assert [r.t for r in store.sorted_by(names, "t").collect()] == ["A", "b", None] and [r.n for r in store.sorted_by(names, "n", True).collect()] == [10, 2, 1]


def test_stream_ingests_each_payload_once(spark, tmp_path):
    for d in ("in", "ok"):
        (tmp_path / d).mkdir()
    run = lambda: ingest.ingest(ingest.files(spark, str(tmp_path / "in")), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check", F.col("payload").startswith("{"))
    (tmp_path / "in/a").write_text("{1}")
    (tmp_path / "in/b").write_text("broken")
    run()
    (tmp_path / "in/c").write_text("{1}")
    (tmp_path / "in/d").write_text("{2}")
    run()
    assert sorted(r.payload for r in spark.read.parquet(f"{tmp_path}/good").collect()) == ["{1}", "{2}"]
    assert [r.payload for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["broken"]


def test_dead_letters_and_digests_in_state(spark, tmp_path):
    listing = lambda *rows: spark.createDataFrame(rows, "name string, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/listing")
    (tmp_path / "one").write_text("{1}")
    (tmp_path / "two").write_text("odd")

    def fetch(key):
        with open(key) as f:
            return f.read()

    def run():
        stream = spark.readStream.schema("name string, key string").parquet(f"{tmp_path}/listing")
        ingest.ingest(ingest.fetched(stream, fetch, attempts=2, base=0.0), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check", F.col("payload").startswith("{"), f"{tmp_path}/dead")
        read = lambda d: spark.read.parquet(f"{tmp_path}/{d}")
        left = ingest.open_dead_letters(read("dead"), read("good"), read("bad"))
        return [sorted(r.name for r in df.collect()) for df in (read("good"), read("bad"), read("dead"), left)]

    listing(("a", f"{tmp_path}/one"), ("b", f"{tmp_path}/two"), ("c", f"{tmp_path}/gone"), ("d", f"{tmp_path}/away"))
    assert run() == [["a"], ["b"], ["c", "d"], ["c", "d"]]
    (tmp_path / "gone").write_text("{3}")
    listing(("again", f"{tmp_path}/one"), ("c", f"{tmp_path}/gone"), ("d", f"{tmp_path}/away"))
    assert run() == [["a", "c"], ["b"], ["c", "d"], ["d"]]
    assert "FileNotFoundError" in spark.read.parquet(f"{tmp_path}/dead").first().error
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest.ingest(ingest.files(spark, f"{tmp_path}/listing"), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/new", F.lit(True))
    with pytest.raises(ValueError, match="dead letters"):
        ingest.ingest(ingest.files(spark, f"{tmp_path}/listing"), f"{tmp_path}/x", f"{tmp_path}/y", f"{tmp_path}/z", F.lit(True), f"{tmp_path}/dead")


def test_break_history_as_a_stream(spark, tmp_path):
    rng = random.Random(3)
    schema, seen, runs, old = "entity long, seq long, row_id string", [], [], spark.createDataFrame([], "row_id string, entity long, first_seq long, last_seq long, closed_seq long")

    def follow(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        breaks.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 3)  # a restart each time
        return spark.read.parquet(f"{tmp_path}/out")

    same = lambda got, want: sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    for step, sequences in enumerate([(1,), (2,), (4, 5), (6,)]):  # two runs at once in the third
        rows = []
        for seq in sequences:
            own = [(e, seq, f"r{e}{k}") for e in (1, 2) for k in range(12) if rng.random() < 0.5 and not (e == 2 and seq == 2)]
            entities = [e for e in (1, 2) if not (e == 2 and seq == 2)]
            runs += [(e, seq) for e in entities]
            seen += own
            rows += own + [(e, seq, None) for e in entities]
            for e in entities:
                old = store.merged_history(old, spark.createDataFrame([(r,) for x, _, r in own if x == e], "row_id string"), e, seq)
            old = spark.createDataFrame(old.collect(), old.schema)
        if step == 3:  # sightings first, their marker in a batch of its own
            follow([r for r in rows if r[2]] + rows[:1])
            rows = [r for r in rows if not r[2]]
        changes = follow(rows)
        every = spark.createDataFrame(runs, "entity long, seq long")
        assert same(breaks.spans(changes, every), store.break_spans(spark.createDataFrame(seen, schema), every))
        assert same(breaks.history(changes, every), old)
    n = changes.count()
    more = follow([(1, 6, None), (1, 3, "r10"), (None, 9, "x"), (1, None, "y")])  # a repeated marker, a late row, rows of no run
    assert more.count() == n + 1 and [(r.row_id, r.seq) for r in more.where("change = 'late'").collect()] == [("r10", 3)]
    after = follow([(1, 8, "r10"), (1, 9, None)])  # run 8 never completes
    assert [(r.row_id, r.seq) for r in after.where("change = 'late' AND seq > 3").collect()] == [("r10", 8)]
    assert after.where("change = 'closed' AND seq = 9").count() == old.where("entity = 1 AND closed_seq IS NULL").count()


def test_break_tables_equal_the_keyed_stream(spark, tmp_path):
    """Batches with runs out of order, markers before and after sightings, repeats and late rows; the last batch runs again."""
    rng = random.Random(11)
    schema, told = "entity long, seq long, row_id string", {}
    arrive = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for _ in range(4):
        rows = [(rng.randrange(6), rng.randrange(1, 9), rng.choice([None, *"abcde"])) for _ in range(rng.randrange(1, 40))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        breaks.follow(arrive(), f"{tmp_path}/tables", f"{tmp_path}/check", 3)
        with ingest.rocks_db(spark):
            breaks.break_changes(arrive(), 3).writeStream.format("parquet").option("path", f"{tmp_path}/keyed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        told = {d: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{d}").select(breaks.NAMES).collect()), key=str) for d in ("tables", "keyed")}
        assert told["tables"] == told["keyed"]
    assert {"opened", "closed", "reopened", "late"} <= {x[3] for x in told["tables"]}
    (tmp_path / "check/commits/3").unlink()
    (tmp_path / "check/commits/.3.crc").unlink(missing_ok=True)
    breaks.follow(arrive(), f"{tmp_path}/tables", f"{tmp_path}/check", 3)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/tables").select(breaks.NAMES).collect()), key=str) == told["tables"]
    with pytest.raises(ValueError, match="another stream"):
        breaks.follow(arrive(), f"{tmp_path}/tables", f"{tmp_path}/new", 3)
    with pytest.raises(ValueError, match="another stream"):
        breaks.follow(arrive(), f"{tmp_path}/more", f"{tmp_path}/state", 3)


def test_break_tables_write_what_a_batch_touches(spark, tmp_path):
    """No call for each entity: state is a table by bucket, and what is untouched stays as it was written."""
    def follow(rows):
        spark.createDataFrame(rows, "entity long, seq long, row_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        breaks.follow(spark.readStream.schema("entity long, seq long, row_id string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 8)
        return {p.name for n in (tmp_path / "check/breaks").glob("batch=*") for p in n.glob("part=[0-9]*") if n.name == f"batch={len(list((tmp_path / 'check/offsets').glob('[0-9]*'))) - 1}"}

    every = follow([(e, 1, r) for e in range(60) for r in ("a", "b", None)])
    assert every == {f"part={k}" for k in range(8)}
    assert len(follow([(7, 2, "a"), (7, 2, None)])) == 1 and len(follow([(7, 3, None)])) == 1
    assert len(list((tmp_path / "check/breaks").glob("batch=*/part=[0-9]*"))) == 9  # eight, and the one before for a batch that runs again
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("seq > 1").select("entity", "row_id", "seq", "change", "last_seq").collect())) == [(7, "a", 3, "closed", 2), (7, "b", 2, "closed", 1)]
    assert not (tmp_path / "check/state").exists()


def test_small_pools_are_searched_by_plain_sums(monkeypatch):
    """The same as by arrays, at caps and budgets of any size, without an array."""
    from tallyloom.operators import closures

    rng, cases = random.Random(4), []
    for _ in range(600):
        high = rng.choice([3, 20, 10**7])
        nets = [rng.randrange(-high, high + 1) for _ in range(rng.randrange(1, 9))]
        cases.append(([f"r{k}" for k in range(len(nets))], nets, sum(v for v in nets if rng.random() < 0.5), rng.choice([1, 2, 8, 200]), rng.choice([1, 8, 64, 1 << 21]), rng.random() < 0.5))
    small = [subsets.closing_subsets(*c) for c in cases]
    with monkeypatch.context() as m:
        m.setattr(closures, "SMALL", -1)
        assert small == [subsets.closing_subsets(*c) for c in cases]
    monkeypatch.setattr(closures, "Pool", None)
    assert subsets.closing_subsets(["a", "b", "c"], [5, -2, 7], 3) == ([("a", "b")], True, "exhausted")


def test_break_stream_asks_its_state_once_a_batch():
    """Each call of the state crosses a process: their number mustn't grow with a bucket's rows."""
    from unittest.mock import MagicMock

    calls = []
    for n in (10, 1_000):
        handle, store_ = MagicMock(), {}
        states = {name: MagicMock() for name in ("known", "waiting")}
        for make in (handle.getValueState, handle.getListState, handle.getMapState):
            make.side_effect = lambda name, schema: states.setdefault(name, MagicMock())  # noqa: B023
        states["known"].get.side_effect = lambda: store_.get("known")  # noqa: B023
        states["known"].update.side_effect = lambda value: store_.update(known=value)  # noqa: B023
        states["known"].iterator.side_effect = lambda: iter(())
        stream = breaks.Breaks()
        stream.init(handle)
        rows = lambda seq: [{"seq": seq, "row_id": f"r{k}", "marker": False} for k in range(n) if seq == 1 or k % 2] + [{"seq": seq, "row_id": None, "marker": True}]  # noqa: B023, E731
        assert len(list(stream.handleInputRows((7, 0), iter(rows(1)), None))) == n
        assert {r["change"] for r in stream.handleInputRows((7, 0), iter(rows(2)), None)} == {"closed"}
        calls.append(sum(len(x.method_calls) for x in states.values()))
    assert calls[0] == calls[1] == 4


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("indent", "head", "tail"), [(None, "[", "]"), (2, "[", "]\n"), (None, '{"entity": "a [\\"{ b", "count": 3, "items": [', '], "more": [{"no": 1}], "last": {"x": {}}}'), (1, '\n{"items":[', "]}\n")])
def test_large_arrays_in_pieces(spark, tmp_path, small_splits, indent, head, tail):
    rng = random.Random(7)
    hard = ["}", "{", '"', "\\", '\\"}', "]", "[{", ",", "é", "\n", "a" * 30, "} , {", '"}']
    objects = [{"id": k, "t": "".join(rng.choice(hard) for _ in range(rng.randrange(6))), "notes": rng.choice([{}, [], {"d": {"e": [{"x": "}"}, {}]}}, None, "}]"])} for k in range(400)]
    objects[17]["t"] = "}" * 3_000  # an item of several splits
    text_ = head + ("," if indent is None else " ,\n ").join(json.dumps(o, indent=indent, ensure_ascii=k % 2 == 0) for k, o in enumerate(objects)) + tail
    (tmp_path / "a.json").write_text(text_)
    path = str(tmp_path / "a.json")
    assert arrays.is_large(spark, path) and spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
    assert [json.loads(r.item) for r in arrays.array_items(spark, path).orderBy("n").collect()] == objects
    assert [json.loads(r.item)["id"] for r in files.items(spark, path).orderBy("n").collect()] == list(range(400))
    schema = "id long, t string"
    from pyspark.sql.types import _parse_datatype_string
    got = files.envelope(spark, path, _parse_datatype_string(schema)).collect()
    assert sorted(map(tuple, got)) == [(o["id"], o["t"]) for o in objects]


def test_arrays_that_are_none(spark, tmp_path, small_splits):
    def read(text_):
        (tmp_path / "b.json").write_text(text_)
        found = arrays.array_items(spark, str(tmp_path / "b.json"))
        return found if found is None else [r.item for r in found.orderBy("n").collect()]

    assert read("[]") == [] and read(' {"items": [ ]}') == [] and read('[ {"a":1} ]') == ['{"a":1}']
    assert read("") is None and read('{"a": 1}\n{"a": 2}') is None and read('{"links": [{"x": 1}], "items": []}') is None
    for bad in ('[{"a": 1}', '[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]', '[,{"a": 1}]', '[1, {"a": 1}]', '[{"a": 1}, 2]', "[1, 2]", '[{"a": 1}] x', '[{"a": 1}]]', "[] x"):
        with pytest.raises(Exception, match="doesn't end|not an object"):
            read(bad)


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert ingest.with_retries(flaky, sleep=waits.append) == "done" and len(waits) == 2 and waits[1] > waits[0]


def test_break_state_stream(spark, tmp_path):
    spark.createDataFrame([("r", 1, True), ("r", 2, True), ("r", 3, False), ("r", 4, True), ("s", 1, False)], "row_id string, seq long, open boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("row_id string, seq long, open boolean").parquet(f"{tmp_path}/in")
    q = ingest.break_states(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.row_id, r.seq, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("r", 1, "opened"), ("r", 3, "closed"), ("r", 4, "reopened")]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 1), "a", 1.0), (datetime(2024, 1, 1, 2), "a", 2.0), (datetime(2024, 1, 9), "a", 3.0)], "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = ingest.windowed_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, 3.0)]


def test_store(spark):
    runs = spark.createDataFrame([("a",), ("a",), ("b",)], "run_id string")
    assert [r.run_id for r in store.new_runs(runs, spark.createDataFrame([("b",)], "run_id string")).collect()] == ["a"]
    history = spark.createDataFrame([("r", 1, 1, 1, None), ("s", 1, 1, 1, None), ("t", 2, 1, 1, None), ("u", 1, 1, 1, 2)], "row_id string, entity int, first_seq int, last_seq int, closed_seq int")
    out = store.merged_history(history, spark.createDataFrame([("r",), ("u",), ("new",)], "row_id string"), 1, 3)
    assert {(r.row_id, r.first_seq, r.last_seq, r.closed_seq) for r in out.collect()} == {("r", 1, 3, None), ("s", 1, 1, 3), ("t", 1, 1, None), ("u", 1, 3, None), ("new", 3, 3, None)}
    spark.range(3).createOrReplaceTempView("numbers")
    assert store.safe_select(spark, "SELECT count(*) AS n FROM numbers;").first().n == 3
    good = "select n.id % 2 AS odd, count(*) AS n, max(';') AS mark FROM numbers n JOIN (SELECT id FROM numbers WHERE id IN (SELECT max(id) FROM numbers) OR id < 2) m ON m.id = n.id GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 LIMIT 5"
    assert [tuple(r) for r in store.safe_select(spark, good).collect()] == [(0, 2, ";"), (1, 1, ";")]
    assert store.safe_select(spark, "SELECT sum(id) OVER (ORDER BY id) AS s FROM numbers WHERE lower('A;') = 'a;' UNION ALL SELECT 1").count() == 4
    for bad in ("DROP TABLE numbers", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) SELECT * FROM x", "INSERT INTO numbers SELECT 1", "SELECT reflect('java.lang.Math', 'abs', -3)", "SELECT java_method('java.lang.Math', 'abs', -3)",
                "SELECT id FROM numbers WHERE id = (SELECT try_reflect('java.lang.Math', 'abs', -3))", f"SELECT * FROM parquet.`{SF}/orders.parquet`", "SELECT * FROM (SELECT * FROM text.`/etc/passwd`)",
                "SELECT * FROM numbers WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "SELECT * FROM (WITH x AS (SELECT 1) SELECT * FROM x)", "SELECT * FROM range(3)", "SELECT system.builtin.reflect('a', 'b')",
                "SELECT TRANSFORM (id) USING 'cat' AS x FROM numbers", "SELECT * FROM no_such_table", "SELECT", "EXPLAIN SELECT 1", "SELECT id FROM numbers LATERAL VIEW java_method('a', 'b') t AS x", "FROM numbers INSERT INTO numbers SELECT 1", ""):
        with pytest.raises(ValueError):
            store.safe_select(spark, bad)


def test_violations_are_raised(spark):
    outcomes = spark.createDataFrame([(1, 1, "verified", "A"), (1, 2, "verified", "A"), (1, 3, "odd", None)], "entity long, bank_index long, kind string, settlement_id string")
    rows = spark.createDataFrame([(1, "A")], "entity long, settlement_id string")
    with pytest.raises(ValueError, match="settlement_verified_twice: 1.*|unknown_kind: 1"):
        gates.require(gates.violations(outcomes, rows))
    gates.require(gates.violations(outcomes.where("bank_index = 1"), rows))


def test_fixture_books_balance(spark):
    rows = fixtures.ledger(spark, "/root/testdata/sf0.001")
    assert rows.where("credit < 0 OR debit < 0").count() == 0 and rows.count() == rows.select("row_id").distinct().count()


def test_journal_of_known_rows(spark):
    """The fee includes its tax, a debit adjustment is a refund, entities that share a row id have a journal each, and other lines' rows stay out."""
    rows = [(1, "a", "payment", 976, 0, 1000, 24, 4, "s1"), (1, "b", "adjustment", 0, 300, 300, None, None, "s1"), (1, "c", "refund", 0, 50, 50, 0, 0, "s1"), (1, "d", "payment", 500, 0, 500, None, None, "s2"),
            (2, "a", "payment", 90, 0, 100, 10, 2, "s1"), (1, "a", "payment", 976, 0, 1000, 24, 4, "s1")]
    ledger = spark.createDataFrame(rows, "entity long, row_id string, type string, credit long, debit long, amount long, fee long, tax long, settlement_id string")
    outcomes = spark.createDataFrame([(1, "verified", "s1"), (1, "verified", "s1"), (1, "ambiguous", "s2"), (2, "reconstructed", "s1")], "entity long, kind string, settlement_id string")
    own = aggregates.claimed_rows(ledger, outcomes)
    lines = aggregates.journal(own)
    assert sorted((r.entity, r.line, r.account, r.debit, r.credit) for r in lines.collect()) == [
        (1, 1, "Bank", 626, 0), (1, 2, "Processing Fees", 24, 0), (1, 3, "Refund Liability", 350, 0), (1, 4, "PSP Clearing", 0, 1000),
        (2, 1, "Bank", 90, 0), (2, 2, "Processing Fees", 10, 0), (2, 3, "Refund Liability", 0, 0), (2, 4, "PSP Clearing", 0, 100)]
    assert all(r.balanced and r.tied for r in aggregates.journal_checks(lines, own).collect())


def test_fees_of_cards(spark):
    cases = [("Amex", "debit", 3), ("Amex", "credit", 3), ("Diners", "credit", 3), ("Diners", "debit", 2), ("RuPay", "debit", 0), ("RuPay", "credit", 2), ("Visa", "credit", 2), (None, None, 2)]
    got = spark.createDataFrame([(n, t, a) for n, t, _ in cases for a in (1, 99_999, 10**9 + 1)], "n string, t string, a long").select("n", "t", "a", money.computed_fee(F.col("a"), F.col("n"), F.col("t")).alias("f"))
    for r in got.collect():
        bare = -(-r.a * next(p for n, t, p in cases if (n, t) == (r.n, r.t)) // 100)
        assert (r.f.fee, r.f.tax) == (bare + -(-bare * 18 // 100), -(-bare * 18 // 100))
    bare = spark.range(1).select(money.computed_fee(F.lit(1000), F.lit(None).cast("string"), F.lit(None).cast("string"), False).alias("f")).first().f
    assert (bare.fee, bare.tax) == (20, 0)


def test_grounds_of_the_supplier_alone(spark):
    accrued = spark.createDataFrame([(1, m, 1000 + k, 180, 3) for k, m in enumerate(("2024-01", "2024-02", "2024-03"))] + [(2, "2024-01", 777, 9, 1)], "entity long, month string, fees long, taxes long, n_rows long")
    invoices = [(1, "G", "g1", "2024-01", 1000, 180, False, False), (1, "G", "g2", "2024-02", 1001, 180, True, True), (1, "X", "x3", "2024-03", 999_999, 1, False, False), (1, "X", "x1", "2024-01", 5, 1, True, True), (2, "X", "y", "2024-01", 5, 1, False, False)]
    gst = spark.createDataFrame(invoices, "entity long, gstin string, invoice_no string, filing_period string, taxable_value long, tax_total long, has_irn boolean, filed boolean")
    assert sorted((r.entity, r.month, r.ground) for r in tax.months_at_risk(accrued, gst).collect()) == [(1, "2024-01", "gstr2b_37a_exposure"), (1, "2024-01", "gstr2b_no_irn"), (1, "2024-03", "gstr2b_absent")]
    assert sorted((r.month, r.residual) for r in tax.residuals(accrued, gst).collect()) == [("2024-01", 0), ("2024-02", 0)]


def test_supplier_of_random_entities(spark):
    """The supplier and its grounds by plain loops; nulls, ties, repeated invoices and entities on one side alone too."""
    rng = random.Random(4)
    months = ["2024-01", "2024-02", "2024-03", None]
    accrued = [(e, m, rng.randrange(-3, 12), 1, rng.choice([0, 1, 2])) for e in (*range(40), None) for m in months if rng.random() < 0.8]
    invoices = [(e, rng.choice(["A", "B", "C", None]), rng.choice(months), rng.choice([None, *range(-3, 16)]), rng.random() < 0.5, rng.random() < 0.5) for e in (*range(3, 44), None) for _ in range(rng.randrange(8))]
    a = spark.createDataFrame(accrued, "entity long, month string, fees long, taxes long, n_rows long")
    g = spark.createDataFrame(invoices, "entity long, gstin string, filing_period string, taxable_value long, has_irn boolean, filed boolean").withColumn("tax_total", F.lit(1).cast("long"))
    hits = Counter((e, gstin) for e, gstin, _, value, *_ in invoices for f, _, fees, _, n in accrued if e is not None and e == f and value is not None and abs(value - fees) <= max(1, n))
    best = {}
    for (e, gstin), n in sorted(hits.items(), key=lambda x: (-x[1], x[0][1] or "")):
        best.setdefault(e, (gstin, n))
    own = [x for x in invoices if x[0] in best and x[1] is not None and x[1] == best[x[0]][0]]
    there = {(e, m) for e, _, m, *_ in own if m is not None}
    want = [(e, m, "gstr2b_absent") for e, m, *_ in accrued if e in best and (e, m) not in there] + [(e, m, "gstr2b_no_irn") for e, _, m, _, irn, _ in own if not irn] + [(e, m, "gstr2b_37a_exposure") for e, _, m, _, _, filed in own if not filed]
    risk = tax.months_at_risk(a, g)
    assert sorted(map(str, map(tuple, risk.collect()))) == sorted(map(str, want)) and len(want) > 50
    supplier = tax.supplier(a, g)
    assert {r.entity: (r.gstin, r.hits) for r in supplier.collect()} == best
    plan = tax.supplier(a, g)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan  # months and invoices are dealt by entity once


def test_pair_metrics_deal_both_sides_at_once(spark):
    flagged = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (4, "b"), (7, None)], "id long, ground string")
    truth = spark.createDataFrame([(1, "a"), (3, "a"), (3, "a"), (None, "a"), (5, "c"), (7, None)], "id long, ground string")
    out = gates.pair_metrics(flagged, truth, ["id", "ground"], "ground")
    assert {r.ground: tuple(r)[1:] for r in out.collect()} == {"a": (1, 2, 2, 3333, 3333), "b": (0, 1, 0, 0, None), "c": (0, 0, 1, None, 0), None: (0, 1, 1, 0, 0)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_settlements_of_two_moments_raise(spark):
    rows = spark.createDataFrame([(1, "s", "a", 5), (1, "s", "b", 6), (1, None, "c", 7), (1, None, "d", 8)], "entity long, settlement_id string, row_id string, settled_at long").selectExpr("*", "'payment' AS type", "1L AS fee", "1L AS credit", "0L AS debit")
    assert aggregates.batches(rows).count() == 1
    assert aggregates.batches(rows.where("row_id <> 'b'"), one_moment=True).count() == 1
    with pytest.raises(Exception, match="two values of settled_at in 1/s"):
        aggregates.batches(rows, one_moment=True).collect()


def test_nation_pools(spark):
    """Sets found in pools of many settlements, added up again."""
    from tallyloom.plans import resolution

    nation = spark.read.parquet(f"{SF}/customer.parquet").toPandas().set_index("c_custkey").c_nationkey.to_dict()
    rows = fixtures.ledger(spark, SF)
    net = {r.settlement_id: (nation[r.entity], r.net) for r in fixtures.settlements(rows).collect()}
    target: dict = {}
    for r in fixtures.bank(rows).collect():
        target[nation[r.entity]] = max(target.get(nation[r.entity], (0, 0)), (r.amount, r.bank_index))
    found: dict = {}
    for r in resolution.c1_nation_pools(spark, SF).collect():
        found.setdefault(r.entity, []).append(r)
        if r.row_ids:
            assert sum(net[s][1] for s in r.row_ids.split("|")) == target[r.entity][0] and {net[s][0] for s in r.row_ids.split("|")} == {r.entity}
    assert found.keys() == target.keys()
    for n, (amount, index) in target.items():
        single = {s for s, (of, v) in net.items() if of == n and v == amount}
        ids = [r.row_ids for r in found[n] if r.row_ids]
        assert len(set(ids)) == len(ids) and {r.bank_index for r in found[n]} == {index}
        assert single <= set(ids) or len(ids) == subsets.CAP


def jobs_of(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    out = work()
    spark.sparkContext.setJobGroup("rest", "others")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_long_chains_take_the_same_jobs(spark):
    """Each line waits for the one before: ten thousand lines within tolerance, three thousand subset searches."""
    counts = {}
    for n in (100, 10_000):
        lines = spark.range(n).selectExpr("7L AS entity", "id AS bank_index", "10 * id AS amount", "5L AS value_day")
        settled = spark.range(n).selectExpr("7L AS entity", "concat('s', id) AS settlement_id", "10 * id + 5 AS net", "5L AS n_rows", "5L AS expected_day")
        near = joins.within_tolerance(lines, settled)
        got, counts[n] = jobs_of(spark, lambda near=near, lines=lines, settled=settled: joins.greedy_matches(near, joins.conflict_components(lines, settled)).collect())
        assert {(r.bank_index, r.settlement_id) for r in got} == {(k, f"s{k}") for k in range(n)}
    assert counts[10_000] <= counts[100] + 3
    for n in (100, 3000):
        ledger = spark.range(n).selectExpr("7L AS entity", "concat('r', lpad(id, 5, '0')) AS row_id", "'refund' AS type", "'p' AS payment_id", "1000L + id % 3 AS credit", "0L AS debit", "1L AS amount", "0L AS fee", "false AS on_hold", "id * 86400 AS created_at", "CAST(NULL AS STRING) AS settlement_id")
        lines = spark.range(n).selectExpr("7L AS entity", "id AS bank_index", "1000L + id % 3 AS amount", "id AS value_day")
        none = spark.createDataFrame([], "entity long, bank_index long, settlement_id string")
        (decided, named), counts[n] = jobs_of(spark, lambda ledger=ledger, lines=lines: cascade.reconstructed(ledger, lines, none))
        assert {(r.bank_index, r.verdict) for r in decided.collect()} == {(k, "determinate") for k in range(n)}
        assert {(r.bank_index, r.row_id) for r in named.collect()} == {(k, f"r{k:05}") for k in range(n)}
    assert counts[3000] <= counts[100] + 3


def test_components_part_lines_without_a_common_settlement(spark):
    rng = random.Random(5)
    lines = [(e, k, rng.randrange(0, 400_000 if e else 9_000), rng.randrange(3)) for e in range(3) for k in range(150)]
    settled = [(e, f"s{k}", rng.randrange(0, 400_000 if e else 9_000), rng.randrange(1, 60), rng.randrange(3)) for e in range(3) for k in range(120)]
    a = spark.createDataFrame(lines, "entity long, bank_index long, amount long, value_day long")
    b = spark.createDataFrame(settled, "entity long, settlement_id string, net long, n_rows long, expected_day long")
    for width in (1 << 20, 1000):
        of = {(r.entity, r.bank_index): r.component for r in joins.conflict_components(a, b, width).collect()}
        assert of.keys() == {x[:2] for x in lines}
        for e in range(3):
            items = sorted([(v, v, k) for i, k, v, _ in lines if i == e] + [(v - n, v + n, None) for i, _, v, n, _ in settled if i == e], key=lambda x: x[:2])
            want, at, reach = {}, None, -1000
            for low, high, k in items:
                if low > reach:
                    at = low
                reach = max(reach, high)
                if k is not None:
                    want[k] = at
            assert {k: c for (i, k), c in of.items() if i == e} == want
    near = joins.within_tolerance(a, b)
    assert sorted(map(tuple, joins.greedy_matches(near).collect())) == sorted(map(tuple, joins.greedy_matches(near, joins.conflict_components(a, b, 1000)).collect()))
    assert joins.greedy_matches(near.limit(0), joins.conflict_components(a, b)).count() == 0


def test_third_stage_beyond_the_pool_bound(spark):
    """A line with a large pool is told of single rows alone; one after it, when settlements have taken their rows, is searched."""
    rows = [(1, f"r{k:02}", "refund", "p", 100 + k, 0, 1, 0, False, 0, "s" if k < 10 else None) for k in range(14)]
    ledger = spark.createDataFrame(rows, "entity long, row_id string, type string, payment_id string, credit long, debit long, amount long, fee long, on_hold boolean, created_at long, settlement_id string")
    lines = spark.createDataFrame([(1, 1, 113, 1), (1, 2, 5, 2), (1, 3, 221, 3), (1, 4, 113, 4)], "entity long, bank_index long, amount long, value_day long")
    matched = spark.createDataFrame([(1, 2, "s")], "entity long, bank_index long, settlement_id string")
    decided, named = cascade.reconstructed(ledger, lines, matched, max_pool=5)
    got = {r.bank_index: (r.verdict, r.n_candidates, r.complete) for r in decided.collect()}
    assert got == {1: ("unresolved", 1, False), 2: ("unresolved", 0, False), 3: ("determinate", 1, True), 4: ("determinate", 1, True)}
    assert {(r.bank_index, r.row_id, r.certain) for r in named.collect()} == {(3, "r10", True), (3, "r11", True), (4, "r13", True)}


def test_third_stage_scored(spark):
    decided = spark.createDataFrame([(1, 1, "determinate"), (1, 2, "determinate"), (1, 3, "determinate"), (1, 4, "ambiguous"), (1, 5, "unresolved"), (1, 6, "determinate")], "entity long, bank_index long, verdict string")
    named = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", True), (1, 2, "c", True), (1, 2, "x", True), (1, 3, "y", True), (1, 4, "z", True), (1, 4, "q", False), (1, 6, "e", True)], "entity long, bank_index long, row_id string, certain boolean")
    rows = spark.createDataFrame([(1, "a", "s1"), (1, "b", "s1"), (1, "c", "s2"), (1, "d", "s2"), (1, "z", "s4"), (1, "e", "s6"), (1, "x", None)], "entity long, row_id string, settlement_id string")
    truth = spark.createDataFrame([(1, 1, "settlement", "s1"), (1, 2, "settlement", "s2"), (1, 3, "foreign_credit", None), (1, 4, "settlement", "s4"), (1, 5, "settlement", "s5"), (1, 6, "settlement", "s6")], "entity long, bank_index long, line_kind string, settlement_id string")
    attested = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s2")], "entity long, settlement_id string")
    got = {r.measure: r.n for r in gates.reconstructions_scored(decided, named, rows, truth, attested).collect()}
    assert got == {"determinate": 4, "ambiguous": 1, "unresolved": 1, "right": 2, "wrong": 1, "foreign_adopted": 1, "without_warrant": 4, "rows_misplaced": 2}


def test_tolerance_in_order_only_where_it_is_shared(spark):
    """What only has each other matches at once; the whole is the same as all pairs taken in order."""
    rng = random.Random(11)
    lines = [(e, i, rng.randint(0, 1) + 1, rng.randint(100, 400)) for e in (1, 2) for i in range(60)]
    settled = [(e, f"s{i:03}", rng.randint(1, 3), rng.randint(0, 2) + 1, rng.randint(100, 400)) for e in (1, 2) for i in range(60)]
    a = spark.createDataFrame(lines, "entity long, bank_index long, value_day long, amount long")
    b = spark.createDataFrame(settled, "entity long, settlement_id string, n_rows long, expected_day long, net long")
    want = sorted(map(tuple, joins.greedy_matches(joins.within_tolerance(a, b)).collect()))
    assert want and sorted(map(tuple, joins.tolerant_matches(a, b).collect())) == want


@pytest.mark.parametrize("name", ["ledger", "erp"])
def test_derived_books_read_the_orders_once(spark, name):
    plan = getattr(fixtures, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_exceptions_meet_the_order_book_once(spark):
    rows, erp = fixtures.ledger(spark, SF), fixtures.erp(spark, SF)
    plan = cascade.book_exceptions(rows, erp)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Join" not in plan
    null = rows.limit(1).withColumn("order_id", F.lit(None).cast("string")).withColumns({"type": F.lit("payment"), "fee": F.lit(1).cast("long")})
    nameless = erp.limit(1).withColumn("order_id", F.lit(None).cast("string"))
    assert sorted(r.exception for r in cascade.book_exceptions(null, nameless).collect()) == ["erp_gap_no_order", "erp_gap_no_payment"]  # null meets nothing


def test_pools_of_few_rows_are_searched_together(monkeypatch):
    """The same as one by one, also where numbers, rows or candidates are too many for it."""
    rng, pools, targets = random.Random(8), [], []
    for _ in range(500):
        high = rng.choice([3, 20, 10**7])
        pools.append([rng.randrange(-high, high + 1) for _ in range(rng.randrange(0, 15))])
        targets.append(sum(v for v in pools[-1] if rng.random() < 0.5))
    pools, targets = [*pools, [1 << 62, 1 << 62, 5]], [*targets, 5]
    asked = [([f"r{k * 7 % 16:02}" for k in range(len(p))], p, t) for p, t in zip(pools, targets, strict=True)]
    for cap, most_debits in ((200, False), (2, True), (32, True)):
        assert subsets.closing_subsets_many(asked, cap, most_debits=most_debits) == [subsets.closing_subsets(*a, cap, most_debits=most_debits) for a in asked]
    monkeypatch.setattr(closures, "search", None)
    few = [a for a in asked[:-1] if 0 < len(a[1]) < 8]
    assert len(subsets.closing_subsets_many(few)) == len(few)


def test_lines_of_a_batch_are_searched_side_by_side(monkeypatch):
    """Only a line without a known settlement waits for the one before, however a batch ends and however few rows are searched at once."""
    import pyarrow as pa

    rng, events = random.Random(9), []
    for entity in range(40):
        for seq in range(1, 9):
            events += [(entity, None, None, None, None, f"r{seq}{k}", rng.choice((-2, 3, 5, 7)), rng.choice((None, seq + 1))) for k in range(rng.randrange(3))]
            events.append((entity, seq, entity * 10 + seq, rng.choice((3, 5, 8, 10)), rng.choice(("s", "s", None)), None, None, None))
    names, long, text_ = ["entity", "seq", "bank_index", "target", "settlement_id", "row_id", "net", "used_seq"], pa.int64(), pa.string()
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*events, strict=True), [long, long, long, long, text_, text_, long, long], strict=True)], names=names)
    calls, search = [], subsets.closing_subsets_many
    monkeypatch.setattr(subsets, "closing_subsets_many", lambda asked, *a, **k: calls.append(len(asked)) or search(asked, *a, **k))

    def lines(size, together):
        calls.clear()
        run = cascade._folded(32, {}, together)
        return sorted((r for b in run(iter([batch.slice(i, size) for i in range(0, len(events), size)])) for r in b.to_pylist()), key=lambda r: r["bank_index"])

    one_by_one = lines(1, 1)
    assert calls.count(0) + calls.count(1) == len(calls) and len(one_by_one) == 320
    assert lines(10_000, 1 << 17) == one_by_one and len(calls) <= 9 < 320 == sum(calls)
    assert lines(10_000, 30) == one_by_one and lines(7, 1 << 17) == one_by_one


def test_rows_ever_drawn_on_meet_their_payment_in_one_window(spark):
    """What ``netted_out`` lists stays away with all that belongs to it, as by joins; a row without a payment is never netted out."""
    rng, rows = random.Random(10), []
    for k in range(150):
        entity, hold, fee, at = k % 4, rng.random() < 0.2, rng.choice((0, 0, None)), k * 50_000
        rows.append((entity, f"p{k}", "payment", None, 100, 0, 100, fee, hold, at))
        for j, amount in enumerate(rng.choice(((), (100,), (60, 40), (50,)))):
            rows.append((entity, f"f{k}_{j}", "refund", f"p{k}", 0, amount, amount, 0, False, at + rng.choice((0, 1, 9)) * 86_400))
        if k % 10 == 0:
            rows += [(entity, f"a{k}", "adjustment", rng.choice((None, f"p{k}")), 0, 30, 30, 0, False, at), (entity, f"p{k}", "payment", None, 70, 0, 70, 0, False, at)]
    ledger = spark.createDataFrame(rows, "entity long, row_id string, type string, payment_id string, credit long, debit long, amount long, fee long, on_hold boolean, created_at long")
    netted = {(r.entity, r.row_id) for r in joins.netted_out(ledger, by_date=True).collect()}
    of = lambda r: (r[0], r[1] if r[2] == "payment" else r[3])
    want = sorted((r[0], r[1], r[4] - r[5]) for r in rows if not r[8] and (r[2] != "payment" or r[7] is not None) and of(r) not in netted)
    drawn = cascade._by_date(ledger)
    assert netted and sorted((r.entity, r.row_id, r.net) for r in drawn.collect()) == want
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_settlements_of_the_books_are_summed_once(spark, monkeypatch):
    """Lines, report and answer key come from one table of settlements."""
    from tallyloom.plans import desk, resolution

    calls, settlements = [], fixtures.settlements
    monkeypatch.setattr(fixtures, "settlements", lambda rows: calls.append(1) or settlements(rows))
    resolution._books(spark, SF)
    assert len(calls) == 1
    desk.g22_third_stage(spark, SF)
    assert len(calls) == 2


def test_pools_are_counted_by_day_only_where_an_entity_is_large(spark, monkeypatch):
    ledger = spark.createDataFrame([(1, f"r{k}", "refund", 10 + k, 0, k, None) for k in range(6)], "entity long, row_id string, type string, credit long, debit long, created_at long, settlement_id string")
    lines = spark.createDataFrame([(1, 1, 23, 1, 1), (1, 2, 15, 1, 2), (1, 3, 999, 1, 3), (2, 4, 0, 1, 1), (None, 5, 10, 1, 1), (1, 6, 10, None, 4)], "entity long, bank_index long, amount long, value_day long, seq long")
    none = spark.createDataFrame([], "entity long, settlement_id string, used_seq long")
    found = lambda **limits: sorted((r.bank_index, r.row_ids, r.status) for r in resolver.searched(ledger, lines, none, **limits).collect() if r.row_ids or limits == {})
    assert [x[:2] for x in found(max_pool=5)] == [(2, "r5")]  # single rows alone
    bounds = resolver.pool_bounds
    monkeypatch.setattr(resolver, "pool_bounds", None)
    few = found()
    monkeypatch.setattr(resolver, "pool_bounds", bounds)
    monkeypatch.setattr(resolver, "kept", lambda df, name: df if name != "large-entities" else lines.limit(1))  # as if one were large
    assert few == found() == [(1, "r0|r3", "exhausted"), (1, "r1|r2", "exhausted"), (2, "r5", "exhausted"), (3, None, "exhausted"), (4, "", "empty_pool")]


def test_the_contract_asks_each_table_once(spark):
    """Checks of a table share its pass: a plan of few joins."""
    e = lambda schema: spark.createDataFrame([], schema)
    found = gates.contract_breaches(
        e("entity long, bank_index long, tier string, kind string, reason string, settlement_id string"), e("entity long, bank_index long, source string, party string"), e("entity long, bank_index long, row_id string"),
        e("entity long, bank_index long, credit_ids array<string>, debit_ids array<string>"), e("entity long, row_id string, proven string, reason string, caused_by long, provable boolean"),
        e("entity long, bank_index long, n long, complete boolean"), e("entity long, bank_index long, rivals long"), e("entity long, row_id string, ground string"))
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") == 4
