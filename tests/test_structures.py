"""Greedy choices in rounds, times by letters, measures of arrays, stages that are done, digests in a tree, runs of two directions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from kymo.functions import runs
from kymo.operators import ledger, measures, near, scripts, spread, stages


def kept_by_fold(rows, like=near.LIKE):
    kept = []
    for k, _, sig in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(1 - (sig ^ s).bit_count() / near.BITS < like for _, s in kept):
            kept.append((k, sig))
    return sorted(k for k, _ in kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_frames_are_chosen_as_by_a_fold(spark, seed):
    """Copies, chains of small steps (each like its neighbours, not the one after), and ties in time."""
    rng = random.Random(seed)
    rows, sig = [], rng.getrandbits(60)
    for k in range(400):
        pick = rng.random()
        if pick < 0.3 and rows:
            sig = rng.choice(rows)[2]
        elif pick < 0.8:
            sig ^= sum(1 << b for b in rng.sample(range(60), rng.randrange(1, 5)))
        else:
            sig = rng.getrandbits(60)
        rows.append((k, float(k // 2), sig))
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, *r) for r in rows[::3]] + [(3, 1, 0.0, None)], "recording_id int, image_id int, ts double, sig long")
    out = near.distinct_frames(df).collect()
    assert sorted(r.image_id for r in out if r.recording_id == 1) == kept_by_fold(rows)
    assert sorted(r.image_id for r in out if r.recording_id == 2) == kept_by_fold(rows[::3])
    assert [r.image_id for r in out if r.recording_id == 3] == [1] and near.distinct_frames(df.limit(0)).count() == 0
    assert 20 < len(kept_by_fold(rows)) < 300


def test_a_static_screen_is_one_node(spark):
    df = spark.range(60_000).selectExpr("1 AS recording_id", "id AS image_id", "CAST(id AS DOUBLE) AS ts", "CASE WHEN id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE (id % 7) * 1000003 * 65537 END AS sig")
    want = kept_by_fold([(k, float(k), 0 if k % 3 == 0 else (k % 7) * 1000003 * 65537) for k in range(60)])
    assert sorted(r.image_id for r in near.distinct_frames(df).collect()) == want


def times_by_walk(paragraphs, spans):
    """The rule as a walk over spans."""
    total = sum(n for _, _, n in spans) or 1
    lengths = [max(1, len(p)) for p in paragraphs]
    done, out = 0, []
    for length in lengths:
        target, walked, at = done / sum(lengths) * total, 0.0, spans[0][0]
        for a, b, n in spans:
            if walked + n >= target:
                at = a + max(0.0, min(1.0, (target - walked) / n if n else 0.0)) * (b - a)
                break
            walked, at = walked + n, b
        out.append(round(at, 4))
        done += length
    return out


def test_paragraphs_take_times_of_their_spans(spark):
    rng = random.Random(4)
    cases = {1: (["a" * 10, "b" * 30, "c" * 20], [(0.0, 10.0, 30), (50.0, 60.0, 30)]), 2: (["x", "y"], [(5.0, 9.0, 0)]), 3: (["p" * 7] * 3, [(1.0, 4.0, 100)])}
    for k in range(4, 30):
        cases[k] = (["w" * rng.randrange(0, 90) for _ in range(rng.randrange(1, 9))], [(10.0 * s, 10.0 * s + rng.randrange(1, 9), rng.randrange(0, 120)) for s in range(rng.randrange(1, 7))])
    p = spark.createDataFrame([(k, i, t) for k, (ps, _) in cases.items() for i, t in enumerate(ps)] + [(99, 0, "no spans")], "recording_id int, paragraph int, text string")
    s = spark.createDataFrame([(k, i, *x) for k, (_, ss) in cases.items() for i, x in enumerate(ss)], "recording_id int, span int, start_s double, end_s double, letters int")
    got = {(r.recording_id, r.paragraph): r.start_s for r in spread.paragraph_times(p, s).collect()}
    assert got.pop((99, 0)) is None
    assert got == {(k, i): pytest.approx(t, abs=2e-4) for k, (ps, ss) in cases.items() for i, t in enumerate(times_by_walk(ps, ss))}
    assert [got[1, i] for i in range(3)] == [0.0, pytest.approx(3.3333), pytest.approx(53.3333)]


def test_measures_of_known_arrays(spark):
    flat, stripes, dark = [128] * 64, [0, 255] * 32, [0] * 64
    df = spark.createDataFrame([(flat, stripes, dark, [], None)], "flat array<int>, stripes array<int>, dark array<int>, none array<int>, nil array<int>")
    c = F.col
    row = df.select(
        measures.contrast(c("flat")).alias("flat_contrast"), measures.contrast(c("stripes")).alias("contrast"), measures.entropy(c("stripes")).alias("bits"), measures.dominant(c("flat")).alias("dominant"),
        measures.density(c("stripes")).alias("density"), measures.difference(c("dark"), c("stripes")).alias("difference"), measures.changed(c("dark"), c("stripes")).alias("changed"), measures.bhattacharyya(c("flat"), c("flat")).alias("same"),
        measures.bhattacharyya(c("flat"), c("dark")).alias("apart"), measures.structure(c("stripes"), c("stripes")).alias("alike"), measures.change(c("stripes"), c("stripes")).alias("still"), measures.change(c("flat"), c("none")).alias("unequal"),
        measures.change(c("flat"), c("nil")).alias("nil"), measures.mean(c("none")).alias("none"), measures.moved_edges(c("flat"), c("flat")).alias("edgeless"),
    ).first()
    assert (row.flat_contrast, row.contrast, row.bits, row.dominant, row.density) == (0.0, 127.5, 1.0, 1.0, 1.0)
    assert (row.difference, row.changed, row.same, row.apart, row.edgeless) == (0.5, 0.5, 0.0, 1.0, 0.0)
    assert row.alike == pytest.approx(1.0) and row.still == pytest.approx(0.0) and row.unequal is row.nil is row.none is None


def test_canonical_json_has_one_form_for_equal_configurations():
    a, b = {"b": {"y": [1, 2], "x": None}, "a": "é"}, {"a": "é", "b": {"x": None, "y": [1, 2]}}
    assert stages.canonical(a) == stages.canonical(b) == '{"a":"é","b":{"x":null,"y":[1,2]}}'
    assert stages.canonical(a, leave=("b",)) == '{"a":"é"}'


def test_fingerprints_equal_those_of_the_whole_payload(spark):
    config = {"z": 1, "a": {"q": True}}
    texts = ["abc", 'say "x" \\ \n\t', "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "source string")
    got = [r[0] for r in rows.select(stages.stage_fingerprint(F.col("source"), "ocr", config)).collect()]
    whole = lambda t: json.dumps([stages.VERSION, t, "ocr", config], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == [hashlib.sha256(whole(t).encode()).hexdigest()[: stages.DIGITS] for t in texts]


def test_a_second_run_works_on_what_changed(spark, tmp_path):
    run = lambda rows, config, stage="ocr": stages.incremental(spark.createDataFrame(rows, "key int, source string"), f"{tmp_path}/ledger", stage, config, lambda df: df, f"{tmp_path}/out")
    assert run([(1, "a"), (2, "b"), (2, "b"), (3, None)], {"k": 1, "m": 2}) == 3
    assert run([(1, "a"), (2, "b"), (3, None)], {"m": 2, "k": 1}) == 0, "the order of keys is no change"
    assert run([(1, "a"), (2, "changed"), (4, "d")], {"k": 1, "m": 2}) == 2
    assert run([(1, "a")], {"k": 1, "m": 3}) == 1 and run([(1, "a")], {"k": 1, "m": 2}, "rewrite") == 1
    assert run([], {"k": 1}) == 0
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 1, 2, 2, 2, 3, 4]


def test_package_ids_do_not_depend_on_partitions_and_change_with_any_file(spark):
    query = next(q for q in ledger.QUERIES if q.name == "package_id")
    rows = [("p", k, f"body {k}") for k in range(500)] + [("q", k, f"body {k}") for k in range(500)]
    ids = lambda rows, n: {r.package: r.package_id for r in query.on(spark, documents=spark.createDataFrame(rows, "source string, doc_id int, text string").repartition(n)).collect()}
    one = ids(rows, 1)
    assert one == ids(rows[::-1], 7) and one["p"] != one["q"]
    changed = ids([(p, k, t + "!" if (p, k) == ("p", 77) else t) for p, k, t in rows], 3)
    assert changed["p"] != one["p"] and changed["q"] == one["q"]
    assert ids([r for r in rows if r[:2] != ("p", 3)], 2)["p"] != one["p"]


@pytest.mark.parametrize(("text", "want"), [
    ("محاضرة 01.mp4 نهاية", [("محاضرة ", True), ("01.mp4 ", False), ("نهاية", True)]), ("... hello", [("... ", False), ("hello", False)]), ("abc", [("abc", False)]), ("", []), (None, []),
    ("سطر\nline\n", [("سطر\n", True), ("line\n", False)]), ("a—ب!", [("a—", False), ("ب!", True)]),
])
def test_runs_of_two_directions(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(runs.runs(F.col("t")), runs.direction(F.col("t"))).first()
    assert [tuple(r) for r in row[0]] == want and "".join(r.text for r in row[0]) == (text or "")
    assert row[1] == ("rtl" if any(r for _, r in want) else "ltr")


def test_arabic_pairs_and_latin_phrases(spark):
    df = spark.createDataFrame([("جدول المقرّرات في الجامعة وجدولُ المقررات", "Open Form Schedule assign C++ ok éabc")], "a string, l string")
    row = df.select(runs.arabic_pairs(F.col("a")), runs.latin_phrases(F.col("l"))).first()
    assert row[0] == ["جدول المقررات", "المقررات الجامعه", "الجامعه وجدول", "وجدول المقررات"], "words of two letters are none"
    assert row[1] == ["Open Form Schedule", "assign C++"]


def test_a_glossary_takes_screen_terms_first_and_no_part_of_a_longer_one(spark):
    texts = spark.createDataFrame([(1, "Form Schedule and more. Form Schedule. Form Schedule! kernel Panic kernel Panic kernel Panic جدول المقررات جدول المقررات جدول المقررات")], "k int, text string")
    screen = spark.createDataFrame([(1, "Form Schedule Assign", 4)], "k int, term string, n long")
    assert [(r.place, r.term, r.origin, r.n) for r in scripts.glossary(screen, texts, "k").orderBy("place").collect()] == [(1, "Form Schedule Assign", "screen", 4), (2, "kernel Panic", "frequency", 3), (3, "جدول المقررات", "arabic", 3)]
    assert [r.term for r in scripts.glossary(screen, texts, "k", 1).collect()] == ["Form Schedule Assign"]
