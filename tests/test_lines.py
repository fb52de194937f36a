"""Lines of screen words put together from runs, however the words lie in the table."""

import random

from pyspark.sql import functions as F

from kymo import fixtures
from kymo.operators import lines, screen

from .test_queries import SF

KINDS = "image_id long, line int, word_idx int, text string, conf double"


def line_rows(found):
    return {(r.image_id, r.line): (r.text, r.conf, r.hit) for r in found.select("image_id", "line", lines.text_of(F.col("runs")).alias("text"), "conf", "hit").collect()}


def wanted(rows):
    out = {}
    for image, line, at, text, conf in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "")):
        out.setdefault((image, line), []).append((text, conf))
    return {k: (" ".join(t for t, _ in v if t is not None) if any(t is not None for t, _ in v) else None, sum(known) / len(known) if (known := [c for _, c in v if c is not None]) else None, any(t == "x" for t, _ in v)) for k, v in out.items()}


def test_lines_of_words_in_any_order(spark):
    rng = random.Random(7)
    texts = ["x", "y y", "", "a\x1fb", "\x1f", None, "Ünï", "z."]
    rows = [(image, line, at, rng.choice(texts), rng.choice([None, 1.5, 90.0])) for image in (1, 2, None) for line in (0, 1, None) for at in [*range(12), 20, 21, 22] if rng.random() < 0.8]
    rows += [(5, 0, k, "twice", 1.0) for k in (0, 1, 2)] * 2 + [(6, 0, None, "nowhere", 2.0), (7, 0, 3, None, None)]
    for way in range(4):
        if way:
            rng.shuffle(rows)
        df = spark.createDataFrame(rows if way < 3 else sorted(rows, key=lambda r: (r[2] or 0) % 2), KINDS).repartition(1 + way)  # the last way: even places lie apart from odd ones
        for by in ((), ("image_id",)):
            assert line_rows(lines.lines(df, *by, conf=F.col("conf"), hit=F.col("text") == "x")) == wanted(rows)
    assert line_rows(lines.lines(spark.createDataFrame([], KINDS), conf=F.col("conf"), hit=F.col("text") == "x")) == {}


def test_a_shuffle_moves_runs(spark):
    words = fixtures.view(spark, SF, "ocr_words")
    moved = []
    for name in ("confident_lines", "labelled_names", "scrubbed_screen_text"):
        plan = next(q for q in screen.QUERIES if q.name == name).on(spark, ocr_words=words)._jdf.queryExecution().executedPlan().toString()
        moved.append((plan.count("Exchange hashpartitioning"), "MapInArrow" in plan, "listagg" in plan))
    assert moved == [(1, True, False)] * 3
