"""Terms that resemble each other against every pair by sequence matching; folds over many keys."""

import random
from difflib import SequenceMatcher

from kymo.operators import folds


def test_pairs_are_all_that_have_the_ratio():
    r = random.Random(5)
    base = ["".join(r.choice("abcdeé") for _ in range(r.choice((0, 5, 9, 14, 70)))) for _ in range(40)]
    terms = sorted({*base, *("".join(r.choice((c, c, c, c, "", "q")) for c in t) for t in base), "abxcdef"[:2] + "cdef", "abucdxy"})
    want = sorted((a, b, round(x, 6)) for k, a in enumerate(terms) for b in terms[k + 1 :] if (x := SequenceMatcher(None, a, b).ratio()) >= 0.8)
    assert sorted(folds.resembling_pairs()([[{"term": t} for t in terms], []])[0]) == want and want


def test_pairs_need_no_run_of_three(spark, tmp_path):
    text = "abqcde abcdze other words here"  # ab, cd and e match: 2 * 5 / 12, but no three letters in a row
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(x) for x in folds.misread_pairs(spark, str(tmp_path)).collect()] == [(1, "abcdze", "abqcde", 0.833333)]


def test_long_lists_fold_as_one_by_one():
    r = random.Random(6)
    rows = [{"term": "".join(r.choice("abc") for _ in range(7)), "n": k} for k in range(700)]
    kept: list[list] = []
    for x in rows:
        found = next((k for k in kept if SequenceMatcher(None, x["term"], k[0]).ratio() >= 0.8), None)
        if found:
            found[1] += x["n"]
        else:
            kept.append([x["term"], x["n"]])
    assert [list(x) for x in folds.fold_misreadings()(rows)] == kept


def test_a_fold_makes_no_frame_for_each_key(spark):
    rows = spark.range(3000).selectExpr("id % 1500 AS key", "id AS at", "if(id % 7 = 0, null, CAST(id AS DOUBLE)) AS x")
    out = folds.fold(rows, "key", ["at"], lambda rs: iter([(len(rs), rs[-1]["at"] - rs[0]["at"], sum(r["x"] != r["x"] for r in rs))]), "n int, apart long, none int")
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert {(r.n, r.apart) for r in out.collect()} == {(2, 1500)} and sum(r.none for r in out.collect()) == 429
