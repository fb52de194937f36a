"""Every query that SQL can express, against SQL; the folds, streams and readers on small literals."""

import hashlib
import json
import os

import pytest

from kymo.operators import folds, registry
from kymo.sources import files
from kymo.streaming import machines

from .compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def seg(k, a, b, text):
    return {"segment_id": k, "start_s": a, "end_s": b, "text": text}


def test_paragraph_breaks_at_a_pause_and_at_length():
    rows = [seg(1, 0, 1, "a"), seg(2, 1, 2, "b"), seg(3, 5, 6, "c" * 700), seg(4, 6, 7, "d")]
    assert [x[2] for x in folds.paragraphs(rows)] == ["a b", "c" * 700, "d"]


def test_timeline_is_lossless():
    rows = [{"kind": "segment", "id": k, "start_s": 10.0 * k, "end_s": 10.0 * k + 9, "text": f"words of {k}."} for k in range(40)]
    rows += [{"kind": "figure", "id": 100 + k, "start_s": 35.0 * k, "end_s": 35.0 * k, "text": ""} for k in range(8)]
    out = list(folds.timeline(sorted(rows, key=lambda r: (r["start_s"], r["kind"] == "segment", r["id"]))))
    assert sum(x[4] for x in out) == 40 and sorted(x[5] for x in out if x[2] == "figure") == sorted(str(100 + k) for k in range(8))
    assert len({x[0] for x in out}) > 1


@pytest.mark.parametrize(("total", "span", "want"), [(0, 0.0, 3500), (597, 312.0, 199), (300, 30.0, 700), (300, 300.0, 150), (10_000, 300.0, 2000), (100_000, 9000.0, 3500), (1399, 180.0, 466), (1400, 180.0, 700)])
def test_batches_follow_from_the_text(total, span, want):
    assert folds.batch_limit(total, span) == want


def test_empty_segments_are_in_no_batch():
    rows = [seg(1, 0, 1, "a" * 600), seg(2, 1, 2, "  "), seg(3, 2, 3, "b" * 200), seg(4, 3, 4, "c" * 900)]
    assert list(folds.batches()(rows)) == [(1, 0), (3, 1), (4, 2)]


def test_a_major_cut_needs_no_gap():
    rows = [{"ts": t, "pixel_diff": d, "threshold": 0.1} for t, d in ((1.0, 0.2), (3.5, 0.2), (4.0, 0.2), (4.5, 0.3), (5.0, 0.05), (7.6, 0.12))]
    assert list(folds.scene_cuts()(rows)) == [(1, 3.5, 0.2, False), (2, 4.5, 0.3, True), (3, 7.6, 0.12, False)]
    assert [c[1] for c in folds.scene_cuts(early=False)(rows)] == [3.5, 7.6] and [c[1] for c in folds.scene_cuts(most=1)(rows)] == [4.5]


def test_chapters_need_three():
    rows = [{"start_s": s, "end_s": s + 20, "title": str(s)} for s in (3.0, 8.0, 30.0, 60.0)]
    assert [x[1] for x in folds.chapters(rows)] == [0.0, 30.0, 60.0]
    assert not list(folds.chapters(rows[:2]))


def test_glossary_passes_over_what_does_not_fit():
    assert [x[0] for x in folds.glossary_budget(12)([{"term": "abcdef"}, {"term": "abcdefghij"}, {"term": "xyz"}])] == ["abcdef", "xyz"]


def test_misreadings_fold_into_the_more_frequent():
    out = dict(folds.fold_misreadings()([{"term": "window", "n": 5}, {"term": "windov", "n": 1}, {"term": "winter", "n": 2}]))
    assert out == {"window": 6, "winter": 2}


def event(seq, op, t, want=0, hold=None, actual=0):
    return {"seq": seq, "op": op, "t": t, "want_units": want, "hold_id": hold, "actual_units": actual}


def play(machine, events):
    state = {}
    return [x for e in events for x in machine(state, e)]


def test_wallet_gives_stale_holds_back_and_settles_once():
    out = play(machines.wallet, [event(1, "add", 0, 100), event(2, "reserve", 0, 60, 7), event(3, "get", 601), event(4, "settle", 602, hold=7, actual=10), event(5, "settle", 603, hold=7, actual=10)])
    assert [x[3] for x in out] == [100, 40, 100, 90, 90] and [x[2] for x in out] == [True, True, True, True, False]


def test_wallet_limits_open_holds():
    out = play(machines.wallet, [event(0, "add", 0, 100), *[event(k, "reserve", 0, 1, k) for k in range(1, 5)]])
    assert [x[2] for x in out] == [True, True, True, True, False]


def test_revoked_licence_stays_revoked():
    step = lambda seq, op, d: {"seq": seq, "op": op, "t": seq, "device": d}
    out = play(machines.licence, [step(1, "activate", 1), step(2, "activate", 2), step(3, "activate", 3), step(4, "revoke", 0), step(5, "reset", 0), step(6, "activate", 1)])
    assert [x[1] for x in out] == ["ok", "ok", "device_limit", "ok", "revoked", "revoked"]


@pytest.mark.parametrize("name", sorted(machines.MACHINES))
def test_stream_equals_batch(spark, name):
    q = machines.queries()
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    streamed = q[f"{name}_stream"](spark, SF)
    assert key(streamed) == key(q[f"{name}_batch"](spark, SF)) != []
    assert len([f for f in os.listdir(f"{streamed._kymo_folder.removeprefix('file://')}/state/commits") if f.isdigit()]) >= 2


def screen(seq, kind, at_ms=0, x=0.0, y=0.0, role="button", app="a"):
    return {"seq": seq, "kind": kind, "at_ms": at_ms, "sx": x, "sy": y, "role": role, "app": app}


def test_steps_of_screen_events():
    events = [
        screen(1, "click", 0), screen(2, "click", 400, 3.0), screen(3, "click", 1000), screen(4, "up", 1100, 30.0), screen(5, "click", 3000, role="textbox"), screen(6, "type", 3100, role="textbox"),
        screen(7, "click", 5000, role="checkbox"), screen(8, "click", 9000, role="checkbox"), screen(9, "enter", 9500), screen(10, "undo"), screen(11, "shortcut", 9900), screen(12, "other"), screen(13, "finish"),
    ]
    assert [(x[0], x[1], x[2], x[3]) for x in play(machines.steps, events)] == [(1, 1, "click", "double"), (3, 2, "click", "drag"), (5, 3, "type", None), (7, 4, "check", None), (8, 5, "uncheck", None), (11, 6, "submit", None)]
    many = [screen(k, "click", 1000 * k) for k in range(300)] + [screen(300, "undo"), screen(301, "finish")]
    assert len(play(machines.steps, many)) == machines.STEPS - 1


def test_a_settle_is_charged_once_however_late():
    events = [event(0, "add", 0, 10_000)]
    for k in range(1, 300):
        events += [event(3 * k, "reserve", k, 10, k), event(3 * k + 1, "settle", k, hold=k, actual=10)]
    out = play(machines.wallet, [*events, event(2000, "settle", 400, hold=1, actual=10)])
    assert out[-1][2] is False and out[-1][3] == 10_000 - 2990


def test_misreadings_fold_whatever_their_first_letters():
    out = dict(folds.fold_misreadings()([{"term": "planned", "n": 5}, {"term": "olanned", "n": 2}, {"term": "Plonned", "n": 1}, {"term": "winter", "n": 1}]))
    assert out == {"planned": 8, "winter": 1}


def test_ratio_of_sequences(spark):
    rows = spark.createDataFrame([("Planned", "plonned"), ("abcd", "bcde"), ("a", None)], "a string, b string")
    assert [r[0] for r in rows.select(folds.sequence_ratio("a", "b")).collect()] == [pytest.approx(12 / 14), 0.75, None]


def test_bootstrap_interval_is_as_wide_as_theory_says(spark):
    rows = spark.range(400).selectExpr("id", "CAST(id % 5 = 0 AS INT) * 10 AS errors", "10 AS words")
    low, high = folds.bootstrap_interval(rows, "errors", "words").first()
    assert low < 0.2 < high and abs((high - low) - 2 * 1.96 * (0.2 * 0.8 / 400) ** 0.5) < 0.01
    assert folds.bootstrap_interval(rows.repartition(7), "errors", "words").first() == (low, high)


def test_losses_of_a_plan(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, id int")
    out = folds.losses(df([(1, 1), (1, 2), (1, 3), (2, 1)]), df([(1, 1), (1, 1), (1, 9), (2, 1)]), df([(1, 3), (1, 1)]), "k")
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {1: (1, 1, 1, 1, False), 2: (0, 0, 0, 0, True)}


def test_fingerprints_of_files(spark, tmp_path):
    big = bytes(range(256)) * 10_000
    for name, body in {"a.mp4": big, "b.mp4": big, "c.mp3": b"c", "x.au": b"123"}.items():
        (tmp_path / name).write_bytes(body)
    want = {n: hashlib.sha256(f"v3|{n}|{len(b)}".encode() + (b if len(b) <= 1 << 20 else b[: 1 << 20] + b[-(1 << 20) :])).hexdigest()[:20] for n, b in {"a.mp4": big, "b.mp4": big, "c.mp3": b"c", "x.au": b"123"}.items()}
    assert {r.name: r.fingerprint for r in files.source_fingerprints(spark.read.format("binaryFile").load(str(tmp_path))).collect()} == want
    inventory = files.media_inventory(spark, str(tmp_path))
    assert inventory.count() == 4
    done = inventory.filter("path LIKE '%a.mp4'").selectExpr("'a.mp4' AS name", "length", "modificationTime").unionAll(inventory.filter("path LIKE '%x.au'").selectExpr("'x.au'", "length + 1", "modificationTime"))
    assert {r.name for r in files.pending_files(inventory, done).collect()} == {"b.mp4", "c.mp3", "x.au"}


def test_study_items_of_all_kinds(spark):
    replies = [
        (1, json.dumps({"objectives": [{"text": "know", "s": [3, "4", 5.0, "x"]}, {"text": 7}, {}, None], "flashcards": [{"front": "f", "back": "b"}], "glossary": "none"})),
        (2, 'so: ```json\n{"questions": [{"q": "why?", "kind": "essay", "options": ["a"], "s": "no list"}]}\n``` done'), (3, "no json"), (4, None), (5, '{"questions": [{"q": "cut'),
    ]
    got = files.study_items(spark.createDataFrame(replies, "id int, reply string")).orderBy("id", "item_type", "item_idx").collect()
    assert [(r.id, r.item_type, r.item_idx, r.front, r.back, r.kind, r.difficulty, r.options) for r in got] == [
        (1, "flashcard", 0, "f", "b", None, None, None), (1, "objective", 0, "know", "", None, None, None), (1, "objective", 1, "7", "", None, None, None), (2, "question", 0, "why?", "", "mcq", "medium", ["a"]),
    ]
    assert got[1].segment_ids[:2] == [3, 4] and got[3].segment_ids == []


def test_job_files(spark, tmp_path):
    for k, body in enumerate(['{"status":"completed","progress":1.0}', "{broken"]):
        (tmp_path / f"job{k}").mkdir()
        (tmp_path / f"job{k}" / "job_state.json").write_text(body)
    found = {r.job_id: r.status for r in files.read_jobs(spark, f"{tmp_path}/*/job_state.json").collect()}
    assert found == {"job0": "completed", "job1": "failed"}


def test_recordings_summary(spark, tmp_path):
    for k, body in enumerate(['{"duration_seconds": 12.5}', "no json", '{"duration_seconds": "x"}']):
        (tmp_path / f"{k}.recording.json").write_text(body)
    row = files.recordings_summary(spark, f"{tmp_path}/*.recording.json").first()
    assert (row.recordings, row.seconds) == (3, 12.5)


def test_ocr_tsv_and_inventory_and_audit(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("text\tconf\tleft\ttop\twidth\theight\nhello\t90\t20\t10\t8\t4\n \t90\t1\t1\t1\t1\nbad\t-1\t1\t1\t1\t1\nx\t50\ta\t1\t1\t1\n")
    rows = files.read_ocr_tsv(spark, f"{tmp_path}/w.tsv", 2.0).collect()
    assert [(r.text, r.left) for r in rows] == [("hello", 10.0)]
    (tmp_path / "media").mkdir()
    (tmp_path / "media/a.mp4").write_bytes(b"x")
    (tmp_path / "media/b.txt").write_bytes(b"x")
    assert [r.is_video for r in files.media_inventory(spark, f"{tmp_path}/media").collect()] == [True]
    (tmp_path / "audit.jsonl").write_text(json.dumps({"source": "a", "bytes": 3, "text_left_device": None}) + "\n")
    assert files.read_audit(spark, f"{tmp_path}/audit.jsonl").first().bytes == 3


def test_text_sinks(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.5, "hello there"), (1, 2, 1.5, 3661.25, "again")], "recording_id int, cue int, start_s double, end_s double, text string")
    files.write_subtitles(cues, f"{tmp_path}/srt")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/srt/recording_id=1").collect())
    assert "00:00:01,500 --> 01:01:01,250" in text
    files.write_transcripts(cues, f"{tmp_path}/txt", timecodes=True)
    assert "[00:00:01] again" in [r.value for r in spark.read.text(f"{tmp_path}/txt/recording_id=1").collect()]
    files.write_chapters(cues.withColumnRenamed("text", "title"), f"{tmp_path}/ch")
    assert "0:01 again" in [r.value for r in spark.read.text(f"{tmp_path}/ch/recording_id=1").collect()]
    files.write_flashcards(cues.selectExpr("text AS front", "text AS back", "start_s"), f"{tmp_path}/cards")
    assert spark.read.option("header", True).csv(f"{tmp_path}/cards").count() == 2
    files.write_report(cues, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from kymo.functions import text

    t, p = F.col("t"), F.col("p")
    assert one(spark, text.collapse_repeats(t), t="شكرا لكم شكرا لكم شكرا لكم شكرا لكم") == "شكرا لكم"
    assert one(spark, text.normalize_arabic(t, True), t="مـــرحبًا  ، é") == "مرحبا، é"
    assert one(spark, text.strip_known_phrases(t), t="hello Subtitles by the Amara.org community .") == "hello"
    assert one(spark, text.strip_prompt_echo(t, p), t="This lecture is about Spark joins. Now we begin.", p="this lecture is about spark joins") == "Now we begin."
    assert one(spark, text.jaccard3(t, p), t="a b c d", p="a b c e") == pytest.approx(1 / 3)
    shuffled = one(spark, text.shuffled_options(t, F.split(p, ",")), t="q", p="x,All of the above,y,z")
    assert shuffled[-1] == "All of the above" and sorted(shuffled[:3]) == ["x", "y", "z"]
    text.register(spark)
    assert tuple(spark.sql("SELECT kymo_fold(' A-b! '), kymo_overlap(0, 4, 2, 8), kymo_half_up(0.25)").first()) == ("a b", 0.5, 0.3)


def test_evaluation_set_and_inbox(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"eval_id": "e1", "clips": [{"name": "a", "source": "s", "start": 0.0, "duration": 20.0, "hyp": "x"}]}))
    (tmp_path / "r.json").write_text(json.dumps({"eval_id": "e1", "clips": {"a": {"text": "x y", "reviewed": True, "exclude": False}}}))
    assert files.read_eval_set(spark, f"{tmp_path}/m.json", f"{tmp_path}/r.json").first().ref.text == "x y"
    (tmp_path / "r2.json").write_text(json.dumps({"eval_id": "e2", "clips": {}}))
    with pytest.raises(ValueError, match="another evaluation"):
        files.read_eval_set(spark, f"{tmp_path}/m.json", f"{tmp_path}/r2.json").collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mp4").write_bytes(b"x")
    (tmp_path / "in/b.txt").write_bytes(b"x")
    for k in range(2):
        files.watch_inbox(spark, f"{tmp_path}/in", f"{tmp_path}/ledger", f"{tmp_path}/state")
        assert spark.read.text(f"{tmp_path}/ledger").count() == k + 1
        (tmp_path / "in/c.mp3").write_bytes(b"y")
    assert {json.loads(r.value)["status"] for r in spark.read.text(f"{tmp_path}/ledger").collect()} == {"taken"}
