"""Exact top-k search against SQL and against all scores in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import registry, topk

from ..compare import same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    same(registry.queries()["op12_topk"](spark, SF), registry.oracle_sql()["op12_topk"], SF)


def brute(ids, x, asked, k):
    x = np.floor(np.asarray(x, np.float64) * topk.SCALE).astype(np.int64)
    out = []
    for a in asked:
        scores = x @ x[a]
        rows = [r for r in np.lexsort((ids, -scores)) if ids[r] != ids[a]][:k]
        out += [(int(ids[a]), n, int(ids[r]), int(scores[r])) for n, r in enumerate(rows, 1)]
    return sorted(out)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["random", "copies", "few values", "one of them large"])
def test_all_blocks_and_passes_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(12)
    n, d = 1000, 12
    x = rng.normal(0, 0.3, (n, d))
    if kind == "copies":
        x[rng.permutation(n)[:400]] = x[3]
    if kind == "few values":
        x = rng.integers(-1, 2, (n, d)) / 2
    if kind == "one of them large":
        x[:, 4] *= 100
    ids = rng.permutation(10 * n)[:n]
    df = frame(spark, ids, x)
    got = topk.search(df, df.filter("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(ids, x, np.flatnonzero(ids % 50 == 0), topk.K)


def test_reading_stops_before_the_ends_and_leaves_few_rows_in():
    """Where some components decide, most rows are never read to the end; no best row is out."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 40, (8000, 16)) * (0.6 ** np.arange(16))).astype(np.int64)
    lists = topk.Lists(np.arange(8000), x)
    for a in range(0, 200, 20):
        rows = lists.left_in(x[a].astype(float), a, 5, -np.inf)
        best = [r for r in np.argsort(-(x @ x[a]), kind="stable") if r != a][:5]
        assert set(best) <= set(rows.tolist()) and len(rows) <= 8000 // topk.LEFT
    assert lists.depth < topk.PARTS // 2


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (8, [-0.001, 0.0]), (9, [0.5, 0.5]), (50, [2.0]), (100, [1e9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "h", "query", "score", "rank", "place")})
    got = topk.search(df, df.filter("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 32768), (0, 2, 9, 32768), (0, 3, 8, -256)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_one_id_with_several_vectors(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, df.filter("vec_id = 50")).collect())) == [(50, 1, 1, 768 * 256), (50, 1, 1, 768 * 512)]
