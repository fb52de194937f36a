"""Names in lines of screen words: what is no part of a name isn't kept."""

from kymo.operators import screen
from kymo.plans.query import Dialect


def test_only_words_of_names_are_kept(spark):
    query = next(q for q in screen.QUERIES if q.name == "person_names")
    assert "listagg(text" not in query.text(Dialect(True))
    words = [(1, 0, 1, "Stone."), (1, 0, 0, "Anna"), (1, 1, 0, "Anna"), (1, 1, 1, "went"), (1, 2, 0, "Anna Mary"), (1, 2, 1, None), (1, 2, 2, "Stone"), (1, 3, 0, "File"), (1, 3, 1, "Open")]
    rows = spark.createDataFrame([(*w, 90.0, 0.0, 0.0, 8.0, 14.0) for w in words], "image_id long, line int, word_idx int, text string, conf double, left_px double, top_px double, width_px double, height_px double")
    assert sorted(tuple(r) for r in query.on(spark, ocr_words=rows).collect()) == [(1, 0, "Anna Stone."), (1, 2, "Anna Mary Stone")]
