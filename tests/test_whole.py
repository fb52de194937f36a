"""Operators over a caller's own tables: whole tables and texts, and cases that the given tables don't hold."""

from kymo import fixtures
from kymo.operators import ledger, plan, screen, terms, transcript

from .compare import same
from .test_queries import SF


def query(module, name):
    return next(q for q in module.QUERIES if q.name == name)


def over_given(spark, q):
    return q.on(spark, **{name: fixtures.view(spark, SF, name) for name in q.inputs})


def test_timeline_has_the_segments_of_every_recording(spark):
    q = query(plan, "merged_timeline")
    out = over_given(spark, q)
    assert out.filter("kind = 'segment'").count() == fixtures.view(spark, SF, "segments").count()
    same(out, q.oracle(), SF)


def test_batch_summary_has_every_failed_file(spark):
    facts = spark.createDataFrame([(1, "a", "failed", "small"), (2, "b", "completed", "small"), (900, "c", "failed", "small"), (901, "d", "completed", "large"), (902, "e", "failed", None)], "seq long, job_key string, status string, model string")
    out = query(ledger, "batch_summary").on(spark, job_facts=facts)
    assert {tuple(r) for r in out.collect()} == {("small", 3, 1, 2, 1, "a"), ("small", 3, 1, 2, 900, "c"), ("large", 1, 1, 0, None, None), (None, 1, 0, 1, 902, "e")}


def test_logs_are_scrubbed_to_their_end_by_every_pattern(spark):
    secrets = ["Authorization: Bearer abc.def", "API_KEY = k1,", "hf_Abc123", "sk-live-9", "token = t0k;", "0" * 32, "password=pw", "me@example.org"]
    rows = [(k, "x " * 3000 + t) for k, t in enumerate(secrets)] + [(99, "nothing")]
    out = {r.doc_id: r.text for r in query(screen, "scrubbed_logs").on(spark, documents=spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = ["Authorization: Bearer [REDACTED]", "API_KEY = [REDACTED],", "[REDACTED_HF_TOKEN]", "[REDACTED_API_KEY]", "token = [REDACTED];", "***", "password=***", "***"]
    assert out == {k: "x " * 3000 + t for k, t in enumerate(want)} | {99: "nothing"}


def test_tokens_of_the_whole_text_support_every_block(spark):
    docs = spark.createDataFrame([(1, "pad " * 1000 + "Latecomer 42"), (2, "short")], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, 7, "latecomer 42"), (2, 0, "Invented short Invented")], "plan_id long, block_idx int, text string")
    assert sorted(tuple(r) for r in query(plan, "unsupported_tokens").on(spark, plan_blocks=blocks, documents=docs).collect()) == [(1, 0), (2, 1)]


def test_glossaries_read_whole_texts_and_skip_parts_of_accepted_terms(spark):
    docs = spark.createDataFrame([(1, "pad " * 1000 + "lateterms lateterms scheduler")], "doc_id long, text string")
    blocks = spark.createDataFrame([(1, 0, "Form Scheduler Assign")], "plan_id long, block_idx int, text string")
    run = lambda name: [tuple(r) for r in query(terms, name).on(spark, plan_blocks=blocks, documents=docs).collect()]
    assert run("glossary_candidates") == [(1, "form scheduler assign", "screen"), (1, "lateterms", "frequency")]
    assert run("augmented_glossary") == [(1, "lateterms", 2)]


def test_loops_are_of_whole_texts(spark):
    texts = ["the first thing", "the second", "the third", "شكرا لكم", "شكرًا لكم.", "شكرا  لكم!", "Word " * 20, "Word " * 20, "Word " * 20, "twice", "twice", "", "", ""]
    rows = [(1, k, float(k), k + 1.0, t) for k, t in enumerate(texts, 1)]
    out = query(transcript, "collapsed_repeats").on(spark, segments=spark.createDataFrame(rows, "recording_id long, segment_id long, start_s double, end_s double, text_raw string"))
    assert {r.first_id: (r.merged, r.start_s, r.end_s) for r in out.filter("merged > 1").collect()} == {4: (3, 4.0, 7.0)}
    assert out.count() == len(texts) - 2
