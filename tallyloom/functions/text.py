"""Small text functions: identifiers, tokens, check digits and similarity."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters of a GSTIN by value.
GSTIN_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trailing_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1).try_cast("long")


def tokens(text: Column) -> Column:
    """Distinct words of 3 to 40 letters and digits, in lower case, sorted."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 40))))


def gstin_check(body: Column) -> Column:
    """The check character of the first fourteen of a GSTIN: weights 1 and 2 in turn, digits of base 36 summed."""
    alphabet = F.lit(GSTIN_CHARACTERS)
    total = F.lit(0)
    for k in range(14):
        value = _value(body, k) * (1 + k % 2)
        total = total + F.floor(value / 36) + value % 36
    return F.substring(alphabet, ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))


def _value(body: Column, k: int) -> Column:
    return F.position(F.substring(body, k + 1, 1), F.lit(GSTIN_CHARACTERS)) - 1


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts between bars."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def without_fences(sql: Column) -> Column:
    """SQL text without markdown fences and closing semicolons."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(sql), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.trim(F.regexp_replace(bare, r";\s*$", ""))


def similarity(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_similarity(a: str, b: str) -> float:
    """The best similarity between the common words and each side's words, order and repeats aside."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left, right = (" ".join([*([common] if common else []), *sorted(s - (x & y))]) for s in (x, y))
    if common and (x <= y or y <= x):
        return 100.0
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])
    return max(similarity(p, q) for p, q in pairs)


#: Cells of a block of pairs that are compared at once.
CELLS = 1 << 22


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, many pairs at once.

    A row of a pair's table of lengths is a row of bits, 64 to a word, and the next one is a sum with carries: each
    character of the shorter text is a few operations on the words of all pairs of a block. Pairs of like lengths
    share a block; blocks are bounded, a very long pair is one of its own.
    """
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    found = np.zeros(len(pairs), np.int64)
    rest = []
    for k, (x, y) in enumerate(pairs):
        if x == y or not y:
            found[k] = len(y)
        else:
            rest.append(k)
    rest.sort(key=lambda k: (-(-len(pairs[k][0]) // 64), len(pairs[k][1])))
    at = 0
    while at < len(rest):
        words = -(-len(pairs[rest[at]][0]) // 64)
        end = at + 1
        while end < len(rest) and (end - at + 1) * words * 64 <= CELLS and -(-len(pairs[rest[end]][0]) // 64) == words:
            end += 1
        block = rest[at:end]
        found[block] = _block([pairs[k][0] for k in block], [pairs[k][1] for k in block], words)
        at = end
    return found


def _block(a: list[str], b: list[str], words: int) -> np.ndarray:
    narrow = all(map(str.isascii, a)) and all(map(str.isascii, b))
    kind, encoding = (np.uint8, "ascii") if narrow else (np.dtype("<u4"), "utf-32-le")

    def padded(texts: list[str], width: int, fill: int) -> np.ndarray:
        out = np.full((len(texts), width), fill, kind)
        for k, t in enumerate(texts):
            out[k, : len(t)] = np.frombuffer(t.encode(encoding), kind)
        return out

    top = np.iinfo(kind).max  # no character
    x, y = padded(a, words * 64, top), padded(b, max(map(len, b)), top - 1).T.copy()
    v = np.full((len(a), words), np.iinfo(np.uint64).max, np.uint64)
    for row in y:
        same = np.packbits(x == row[:, None], axis=1, bitorder="little").view("<u8")
        u, carry = v & same, np.zeros(len(a), bool)
        up = np.empty_like(v)
        for w in range(words):
            half = v[:, w] + u[:, w]
            up[:, w] = half + carry
            carry = (half < u[:, w]) | (up[:, w] < half)
        v = up | (v & ~same)
    return words * 64 - np.bitwise_count(v).sum(axis=1, dtype=np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``similarity`` of many pairs."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(size == 0, 100.0, 200.0 * common_subsequences(a, b) / np.maximum(size, 1))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set_similarity`` of many pairs.

    The common words begin both sides, so what a side shares with them is known, and only the rest is compared.
    """
    best, size, head, left, right = np.zeros((5, len(a)), object)
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        common = " ".join(sorted(x & y))
        own = [" ".join(sorted(s - (x & y))) for s in (x, y)]
        head[k] = len(common) + bool(common and all(own))  # a space follows where both go on
        full = [len(common) + len(o) + bool(common and o) for o in own]
        left[k], right[k], size[k] = *own, sum(full)
        if common:
            best[k] = max(200.0 * len(common) / (len(common) + f) for f in full)
    shared = common_subsequences(list(left), list(right)) + head.astype(np.int64)
    size = size.astype(np.int64)
    whole = np.where(size == 0, 100.0, 200.0 * shared / np.maximum(size, 1))
    return np.maximum(best.astype(float), whole)


def similarities(kind: str = "token_set"):
    """Similarity of two text columns, a batch of rows at a time; null where either is null."""
    import pandas as pd

    score = token_set_ratios if kind == "token_set" else ratios

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[there] = score(list(a[there]), list(b[there]))
        return pd.Series(out).where(there, None)

    return of


#: Provenance of a value, weakest first.
TIERS = ["synthesized_modelled", "synthesized_documented", "captured_real"]


def weakest(tiers: Column) -> Column:
    """The weakest of an array of provenance tiers."""
    return F.element_at(F.array(*map(F.lit, TIERS)), F.array_min(F.transform(tiers, lambda t: F.array_position(F.array(*map(F.lit, TIERS)), t))).cast("int"))


def notes(value: Column) -> Column:
    """The notes of a row as a map: an object as it is, anything else as none."""
    return F.coalesce(F.when(F.trim(value).startswith("{"), F.from_json(value, "map<string,string>")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
