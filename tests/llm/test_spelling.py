"""Spelling variants against SQL, and the pivotal grams against all pairs of words."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kymo.llm import registry, spelling

from ..compare import same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    same(registry.queries()["op11_spelling"](spark, SF), registry.oracle_sql()["op11_spelling"], SF)


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in spelling_runs(text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: next((v for v in sorted(close[w], key=lambda v: (-n[v], v))[:1] if n[v] >= 2 * n[w]), None) for w in n}
    for w in sorted(n):
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(close[w]), n.get(form[w])


def spelling_runs(text):
    return ["".join(g) for ok, g in itertools.groupby(text, lambda c: c.isascii() and c.isalpha() or "À" <= c <= "ÿ") if ok]


def made(seed, letters, n):
    """Words and words one to three edits away, often; so that chains and ties arise."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(n)]
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w)
    often = [rng.choice([1, 2, 4, 9, 20]) for _ in words]
    return [(d, " ".join(w for w, most in zip(words, often, strict=True) for _ in range(rng.randrange(most + 1)))) for d in range(12)]


@pytest.mark.parametrize(("letters", "n"), [("ab", 40), ("abcdefghij", 60), ("aàéÿ÷zxq", 60)])
def test_all_near_words_are_found(spark, letters, n):
    rows = made(11, letters, n)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    want = list(brute(rows))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(w[1] != w[2] and w[1] for w in want)


def test_pivots_have_the_least_sum_and_do_not_overlap():
    rng = random.Random(3)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        weights = [rng.randrange(6) for _ in places]
        a, b = spelling.pivots_of(places, weights)
        of = dict(zip(places, weights, strict=True))
        assert b - a >= 2 and of[a] + of[b] == min(of[x] + of[y] for x in places for y in places if y - x >= 2)


def test_every_near_pair_shares_a_key_of_its_pivots():
    """One edit anywhere: the word whose prefix ends earlier has a pivot key among the other's prefix keys."""
    rng = random.Random(8)
    ranks = {a * 256 + b: rng.randrange(40) for a in range(97, 103) for b in range(97, 103)}
    for _ in range(3000):
        w = bytes(rng.randrange(97, 103) for _ in range(rng.randrange(5, 10)))
        k = rng.randrange(len(w) + 1)
        v = w[:k] + bytes([rng.randrange(97, 103)]) + w[k + rng.randrange(2) :]
        if v == w or len(v) < 5:
            continue
        sides = []
        for x in (w, v):
            order = [ranks[g] * 65536 + g for g in spelling._grams(x)]
            places, last = spelling.prefix_of(order)
            left, right = spelling.pivots_of(places, [ranks[spelling._grams(x)[p]] for p in places])
            pivots = {key for n in (len(x) - 1, len(x), len(x) + 1) for key in (*spelling.left_keys(x, [left], n), *spelling.right_keys(x, [right], n))}
            sides.append((last, pivots, {*spelling.left_keys(x, places, len(x)), *spelling.right_keys(x, places, len(x))}))
        assert (spelling.letters_of(w) ^ spelling.letters_of(v)).bit_count() <= 2
        assert (sides[0][0] <= sides[1][0] and sides[0][1] & sides[1][2]) or (sides[1][0] <= sides[0][0] and sides[1][1] & sides[0][2])


def test_odd_and_empty_tables(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "  1234 ...\n"), (None, "Straße straße STRAßE Strase strase strase strase strase strase"), (4, f"{long} {long} {long} {long}c {long}c {long}c"), (4, "aaaaa AAAAA"), (4, "aaaaa AAAAA")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "key", "run", "root", "form")})
    got = {r.word: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert got == {w[0]: w[1:] for w in brute(rows)}
    assert got["strase"][3] == 1 or got["strase"][3] == 0
    assert got[long][3] == 1 and got["aaaaa"] == (None, "aaaaa", 4, 0, None)
    assert spelling.variants(df.limit(0)).count() == 0
