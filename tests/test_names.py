"""Names, noise terms and nested plans on cases with known results."""

import random

from pyspark.sql import functions as F

from kymo.functions import names, plans

from .test_titles import values

KNOWN = ["Mohamed", "Hanaa", "Maged", "Abdullah", "Reem"]


def test_names_of_people(spark):
    cases = {
        "Mohame... Hesha — 00:47:26": True, "My Staff Hanaa": True, "Abdullah Omran": True, "rashad abdelmohaymen abu alsaimi": True, "Adwaa Alwaqdani": True,
        "Performance Matters": False, "Schoology Learning": False, "McGraw Hill": False, "Local Disk": False, "Reem": False, "Algebra Lessons": False, "View Account Alsubaie": False, "": False,
    }
    assert dict(zip(cases, values(spark, lambda t: names.looks_like_person_name(t, KNOWN), list(cases)), strict=True)) == cases
    assert values(spark, lambda t: names.looks_like_person_name(t), [None]) == [False]


def test_spans_of_names(spark):
    lines = ["AA Alhanouf Alsubaie View Account", "Open Mohamed Ali Hassan Omar Saleh now", "Mohame... Hesha joined", "Lesson Planner", "12:15 PM alone Reem Nasser, then"]
    rows = [(1, k, i, w) for k, line in enumerate(lines) for i, w in enumerate(line.split())]
    got = {(r.line, r.first_word, r.last_word, r.name) for r in names.name_spans(spark.createDataFrame(rows, "image_id int, line int, word_idx int, text string"), KNOWN).collect()}
    assert (0, 1, 2, "Alhanouf Alsubaie") in got and (2, 0, 1, "Mohame Hesha") in got and not any(line == 3 for line, *_ in got)
    assert any(line == 1 and name.startswith("Open Mohamed Ali Hassan") for line, _, _, name in got)  # the longest window first, then its neighbours
    assert any(line == 4 and "Reem Nasser" in name for line, _, _, name in got)


def test_noise_terms(spark):
    cases = {"Start": True, "Reset Filters": True, "pervisor": True, "ate text fro": True, "OneNote Class Notebook mij": True, "Task Sched Comp Responsible Resp": True, "Mohamed Ali": True, "Monitoring and Feedback": False, "Lesson Observation": False, "": True}
    assert dict(zip(cases, values(spark, lambda t: names.is_noise_term(t, F.lit("screen"), KNOWN), list(cases)), strict=True)) == cases


def test_plans_that_cannot_be_read_have_no_blocks(spark):
    plans.register(spark)
    rows = [(1, '{"sections":[{"blocks":[{"kind":"figure","text":"a","source_start":1.5}]},{},{"blocks":[{"text":"b"}]}]}'), (2, "{broken"), (3, None), (4, "[]")]
    df = spark.createDataFrame(rows, "plan_id int, plan string")
    df.createOrReplaceTempView("odd_plans")
    want = [(1, 0, 0, "figure", "a", 1.5, None), (1, 2, 1, None, "b", None, None)]
    assert [tuple(r) for r in spark.sql("SELECT plan_id, e.* FROM odd_plans, LATERAL explode_plan(plan) e ORDER BY block_idx").collect()] == want
    assert sorted(map(tuple, plans.flat(df).collect())) == want


def test_what_is_seen_before_a_text_is_cut_hides_no_name(spark):
    rng = random.Random(5)
    parts = ["Alsaimi", "abu", "(Alharbi)", "also", "Binladen;", "ABDULLAH", "Omar", "Mohamed.", "View", "x", "al", "El-Sayed", "[elsayed", "Sara", "Mo...", "…ab", "..", " Ibnamin", "malsaimi"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) for _ in range(600)]
    for known in ([], KNOWN):

        def plain(t, known=known):
            words = names._tokens(t)
            at = lambda n: F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: names.is_name_line(F.slice(words, i, n), known))
            windows = [at(n) for n in (4, 3, 2)]
            clear = F.exists(words, lambda w: w.rlike(names.NAME) & names._is_known(w, known) & ~F.lower(w).isin(names.AMBIGUOUS))
            return F.exists(F.split(t, r"(?U)\s+"), names.is_truncated) | clear | windows[0] | windows[1] | windows[2]

        got = values(spark, lambda t, known=known: names.looks_like_person_name(t, known), texts)
        assert got == values(spark, plain, texts) and 50 < sum(got) < 550
        seen = values(spark, lambda t, known=known: names._may_hold_person(t, known), texts)
        assert known or not all(seen)


def test_lines_without_a_word_of_a_name_are_left_out_before_they_are_walked(spark):
    rows = [(1, 0, 0, "Omar"), (1, 0, 1, "Alsaimi,"), (1, 1, 0, "plain"), (1, 1, 1, "words"), (1, 2, 0, "Moha..."), (1, 2, 1, None), (1, 3, 0, None)]
    found = names.name_spans(spark.createDataFrame(rows, "image_id int, line int, word_idx int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0, 1, "Omar Alsaimi"), (1, 2, 0, 0, "Moha")]
    assert "max(hit" in found._jdf.queryExecution().optimizedPlan().toString()
