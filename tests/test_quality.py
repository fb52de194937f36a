"""Quality of plans: every metric can fail, and what doesn't apply has no weight."""

import pytest

from kymo.operators import quality

SENTENCE = "هذه جملة كاملة عن الموضوع المطروح في المحاضرة وتنتهي بنقطة. " * 4
SCHEMA = "plan_id int, section_idx int, section_title string, block_idx int, kind string, text string, caption string, ocr_text string, source_start double, source_end double"


def para(text, at=None):
    return ("paragraph", text, None, None, *(at or (None, None)))


def figure(caption, ocr=""):
    return ("figure", None, caption, ocr, None, None)


def judged(spark, *plans):
    """Metrics of plans, each a list of (title, blocks)."""
    rows, n = [], 0
    for p, sections in enumerate(plans):
        for s, (title, blocks) in enumerate(sections):
            for b in blocks:
                rows.append((p, s, title, n, *b))
                n += 1
    found = quality.metrics(spark.createDataFrame(rows, SCHEMA))
    scores = {r.plan_id: r.score for r in quality.score(found).collect()}
    return [r.asDict() | {"score": scores[r.plan_id]} for r in found.orderBy("plan_id").collect()]


def test_broken_paragraphs_and_pauses(spark):
    cut = SENTENCE.rstrip(". ") + " ثم"
    whole, broken, paused, last = judged(
        spark, [("فصل الخوارزميات", [para(SENTENCE), para(SENTENCE)])], [("فصل الخوارزميات", [para(cut), para(cut)])],
        [("فصل الخوارزميات", [para(cut, (0.0, 5.0)), figure("x"), para(SENTENCE, (6.0, 9.0))])], [("فصل الخوارزميات", [para(cut, (0.0, 5.0)), para(cut, (5.5, 9.0))])],
    )
    assert [p["paragraph_flow"] for p in (whole, broken, paused, last)] == [100.0, 0.0, 100.0, 0.0]
    assert broken["score"] < whole["score"] == 100.0


def test_walls_and_shreds_of_text(spark):
    wall, shred, fine = judged(spark, [("فصل الخوارزميات", [para(SENTENCE * 40)])], [("فصل الخوارزميات", [para("قصير.")])], [("فصل الخوارزميات", [para(SENTENCE)])])
    assert [p["paragraph_balance"] for p in (wall, shred, fine)] == [0.0, 0.0, 100.0]


def test_titles_that_say_nothing(spark):
    text = [para(SENTENCE)]
    ordinal, named, loop, twice, one = judged(
        spark, [("القسم الأول — من 00:00:00", text), ("القسم الثاني — من 00:05:00", text)], [("تعريف الخوارزمية", text), ("أمثلة تطبيقية", text)], [("أخطر القلب وأخطر القلب وأخطر القلب", text)],
        [("متابعة تحضير المعلمين", text), ("متابعة  تحضير المعلمين ", text)], [("timetable?semesterid=1186991", text), ("تعريف الخوارزمية", text)],
    )
    assert [p["section_titling"] for p in (ordinal, named, loop, twice, one)] == [0.0, 100.0, 0.0, 0.0, 50.0]


@pytest.mark.parametrize(("caption", "good"), [
    ("لقطة عند 00:00:03", False), ("صورة 1", False), ("صورة 2 — 00:00:20", False), ("شكل 5", False), ("", False), (None, False), ("مخطّط تدفّق الخوارزمية", True),
    ("مخطّط تدفّق الخوارزمية — 00:05:59", True), ("Bi Lessons | Chalk - Googke Chrome", False), ("timetable?semesterid=1186991 — 00:05:59", False),
])
def test_captions(spark, caption, good):
    (plan,) = judged(spark, [("الأشكال", [para(SENTENCE), figure(caption)])])
    assert plan["figure_captioning"] == (100.0 if good else 0.0)


def test_figures_whose_text_is_part_of_another(spark):
    built, apart, alone = judged(spark, [("الأشكال", [figure("a", "نقطة أولى"), figure("b", "نقطة أولى ونقطة ثانية"), figure("c", "شيء آخر"), figure("d", " ")])], [("الأشكال", [figure("a", "same"), figure("b", "same")])], [("الأشكال", [figure("a", "one")])])
    assert built["figure_distinctness"] == pytest.approx(100 * 2 / 3) and apart["figure_distinctness"] == 0.0 and alone["figure_distinctness"] is None


def test_sections_of_one_size_and_what_does_not_apply(spark):
    even, uneven, bare = judged(spark, [("تعريف الخوارزمية", [para(SENTENCE)]), ("أمثلة تطبيقية", [para(SENTENCE)])], [("تعريف الخوارزمية", [para(SENTENCE * 30)]), ("أمثلة تطبيقية", [para("نص.")]), ("خاتمة الدرس هنا", [para("")])], [("تعريف الخوارزمية", [figure("مخطّط تدفّق الخوارزمية")])])
    assert even["section_balance"] == 100.0 and uneven["section_balance"] < 5
    assert bare["paragraph_flow"] is bare["paragraph_balance"] is bare["section_balance"] is bare["figure_distinctness"] is None and bare["score"] == 100.0
    assert quality.metrics(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_form_has_a_row_for_each_metric(spark):
    found = quality.metrics(spark.createDataFrame([(1, 0, "تعريف الخوارزمية", 0, *para(SENTENCE))], SCHEMA))
    assert {r.metric: r.value for r in quality.long(found).collect()} == {"paragraph_flow": 100.0, "paragraph_balance": 100.0, "section_titling": 100.0, "section_balance": None, "figure_captioning": None, "figure_distinctness": None}
