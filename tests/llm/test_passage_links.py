"""Links of passages that share a key, against all pairs; keys that are met again; work of a common phrase."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kymo.llm import passages
from kymo.llm.common import whole_groups
from kymo.llm.components import Forest, components, trees

SF = "/root/testdata/sf0.001"


def joined(n, edges):
    forest = Forest(n)
    for a, b in edges:
        forest.join(int(a), int(b))
    return [forest.root(x) for x in range(n)]


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def sets(rng, n, most=25):
    """Sets of which many are copies with up to two shingles changed."""
    pool = [[rng.randrange(40) for _ in range(rng.randrange(1, most))] for _ in range(6)]
    out = []
    for _ in range(n):
        s = list(rng.choice(pool))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.randrange(60)
        out.append(s)
    return out


def binary(found):
    return pa.array([b""] * 2 + [np.array(s, np.uint32).tobytes() for s in found], pa.binary()).slice(2)


@pytest.mark.parametrize(("dense", "compared"), [(2, 7), (3, 50), (64, 1 << 20)])
def test_groups_are_linked_as_by_all_pairs(monkeypatch, dense, compared):
    monkeypatch.setattr(passages, "_DENSE", dense)
    monkeypatch.setattr(passages, "_COMPARED", compared)
    rng = random.Random(dense)
    for _ in range(20):
        number = np.unique(np.sort([rng.randrange(12) for _ in range(rng.randrange(1, 150))]), return_inverse=True)[1]
        found = sets(rng, len(number))
        want = [(a, b) for a in range(len(found)) for b in range(a) if number[a] == number[b] and alike(set(found[a]), set(found[b]))]
        assert joined(len(found), zip(*passages.linked(0.8)(number, binary(found)), strict=True)) == joined(len(found), want)


@pytest.mark.parametrize("most", [200, 900, 1 << 21])
def test_links_of_classes_equal_all_pairs(spark, most):
    rng = random.Random(5)
    found = sets(rng, 160) + [[900, 901, 902, 903, 904 + (k > 20)] for k in range(24)]  # the last are copies, of which most are alike
    keys = [sorted({rng.randrange(7), rng.randrange(7)}) if k < 160 else [9] for k in range(len(found))]
    rows = [(key, uid, bytearray(np.array(s, np.uint32).tobytes())) for uid, (s, of) in enumerate(zip(found, keys, strict=True)) for key in of]
    links = passages.class_links(spark.createDataFrame(rows, "key long, uid long, shingles binary").repartition(3), 0.8, most)
    want = joined(len(found), [(a, b) for a in range(len(found)) for b in range(a) if set(keys[a]) & set(keys[b]) and alike(set(found[a]), set(found[b]))])
    got = {r.node: r.label for r in components(links).collect()}
    assert [got.get(k, k) for k in range(len(found))] == want


def test_a_common_phrase_is_no_work_by_the_square():
    """Twenty thousand passages share a phrase and nothing else but for one pair: one pair is compared, not 200 million."""
    n = 20_000
    found = [[1, 2, 3, *range(10 + 8 * k, 18 + 8 * k)] for k in range(n)]
    found[-1] = [*found[0][:-1], 5]
    row, value = passages._sets(binary(found))
    a, b, dense = passages._pairs(np.zeros(n, np.int64), row, value, np.bincount(row), 0.8)
    assert (a.tolist(), b.tolist(), dense) == ([0], [n - 1], [])


def test_trees_connect_what_edges_connect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 1000):
        a, b = rng.integers(0, max(n, 1), (2, n // 2))
        u, v = trees(n, a, b)
        assert joined(n, zip(u, v, strict=True)) == joined(n, zip(a, b, strict=True))
        assert n == 0 or max(Counter([*u.tolist(), *v.tolist()]).values(), default=0) <= 3


def test_whole_groups_of_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 9, 60)).tolist()
    for size in (1, 4, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size])], names=["key"]) for k in range(0, 60, size)]
        seen = [sorted(Counter(zip(number.tolist(), table.column(0).to_pylist(), strict=True)).items()) for table, number in whole_groups(iter(batches), ["key"])]
        assert [(key, n) for part in seen for (_, key), n in part] == sorted(Counter(keys).items())


def test_keys_that_come_again_and_their_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.text or "").encode() for r in docs.collect()]
    count = Counter(k for _, held in passages.laid(iter(texts)) for u in passages.units(held)[1:] for k in u["keys"].ravel().tolist())
    want = sorted(k for k, n in count.items() if n > 1)
    keys = passages.repeated_keys(docs.repartition(3), "text")
    assert sorted(r.key for r in keys.collect()) == want and len(want) > 100
    for slots in (20, 27):
        bits = np.unpackbits(passages.bitmap_of(keys, slots), bitorder="little")
        assert np.flatnonzero(bits).tolist() == sorted({k & ((1 << slots) - 1) for k in want})
    empty = passages.repeated_keys(docs.filter(F.lit(False)), "text")
    assert empty.count() == 0 and not passages.bitmap_of(empty).any()
