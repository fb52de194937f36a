"""Measures of frames held as arrays of grey values (0 to 255), and how much one frame differs from the one before.

Each measure is an expression over one or two arrays, folded inside a row. ``change`` weighs four of them as the scene detector does. Its structure term is the
similarity of means, spreads and covariance over the whole array, and its edges are steps between neighbours, since an array has no windows and no directions.

Arrays of different lengths, null or empty have null measures; a weight of nothing at all gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Built

# Weights of structure, histogram, changed pixels and edges; the step that changes a pixel; the step of an edge; levels of a histogram; constants of the similarity.
WEIGHTS = (0.30, 0.20, 0.25, 0.25)
CHANGED, EDGE, BINS = 25, 60, 32
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _share(flags: Column) -> Column:
    return _sum(F.transform(flags, lambda x: x.cast("double"))) / F.size(flags)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(F.transform(a, lambda x: x.cast("double"))) / F.size(a))


def contrast(a: Column) -> Column:
    """Standard deviation."""
    return F.sqrt(F.greatest(F.lit(0.0), mean(F.transform(a, lambda x: x.cast("double") * x)) - mean(a) * mean(a)))


def histogram(a: Column, bins: int = BINS) -> Column:
    """How many values lie in each of ``bins`` equal parts of 0 to 255; one fold over the values."""
    places = F.transform(a, lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(x * bins / 256))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)))


def dominant(a: Column) -> Column:
    """Share of the most frequent value."""
    return F.array_max(histogram(a, 256)) / F.nullif(F.size(a), F.lit(0))


def entropy(a: Column) -> Column:
    """Bits of information in the values."""
    shares = F.filter(F.transform(histogram(a, 256), lambda n: n / F.nullif(F.size(a), F.lit(0))), lambda p: p > 0)
    return F.when(F.size(a) > 0, F.abs(_sum(F.transform(shares, lambda p: -p * F.log2(p)))))


def sharpness(a: Column) -> Column:
    """Variance of the second differences."""
    inner = F.when(F.size(a) > 2, F.sequence(F.lit(1), F.size(a) - 2)).otherwise(F.array().cast("array<int>"))
    second = F.transform(inner, lambda i: (F.get(a, i - 1) + F.get(a, i + 1) - 2 * F.get(a, i)).cast("double"))
    return F.coalesce(F.pow(contrast(second), 2), F.when(F.size(a) > 0, F.lit(0.0)))


def edges(a: Column, step: int = EDGE) -> Column:
    """Is there an edge behind each value but the last?"""
    return F.transform(F.when(F.size(a) > 1, F.sequence(F.lit(0), F.size(a) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.abs(F.get(a, i + 1) - F.get(a, i)) > step)


def density(a: Column) -> Column:
    return F.coalesce(_share(F.when(F.size(edges(a)) > 0, edges(a))), F.when(F.size(a) > 0, F.lit(0.0)))


def score(a: Column) -> Column:
    """What makes one frame of a scene better than another: content first, then information and sharpness."""
    return density(a) * 100.0 + F.least(entropy(a), F.lit(8.0)) * 0.5 + F.least(sharpness(a) / 1000.0, F.lit(3.0))


def _paired(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def difference(a: Column, b: Column) -> Column:
    """Mean absolute difference, from 0 to 1."""
    return _paired(a, b, mean(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 255.0)


def changed(a: Column, b: Column, step: int = CHANGED) -> Column:
    """Share of the values that differ by more than ``step``."""
    return _paired(a, b, _share(F.zip_with(a, b, lambda x, y: F.abs(x - y) > step)))


def bhattacharyya(a: Column, b: Column, bins: int = BINS) -> Column:
    """Distance of two histograms: 0 for equal shapes, 1 where none share a level."""
    both = F.zip_with(histogram(a, bins), histogram(b, bins), lambda x, y: F.sqrt(x.cast("double") * y))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.sqrt(F.greatest(F.lit(0.0), 1 - _sum(both) / F.sqrt(F.size(a).cast("double") * F.size(b)))))


def structure(a: Column, b: Column) -> Column:
    """Structural similarity of whole arrays, from -1 to 1."""
    cov = mean(F.zip_with(a, b, lambda x, y: x.cast("double") * y)) - mean(a) * mean(b)
    top = (2 * mean(a) * mean(b) + C1) * (2 * cov + C2)
    return _paired(a, b, top / ((mean(a) * mean(a) + mean(b) * mean(b) + C1) * (F.pow(contrast(a), 2) + F.pow(contrast(b), 2) + C2)))


def moved_edges(a: Column, b: Column) -> Column:
    """1 less the edges of both among the edges of either; 0 without any."""
    both = F.zip_with(edges(a), edges(b), lambda x, y: F.struct((x & y).cast("double").alias("i"), (x | y).cast("double").alias("u")))
    return _paired(a, b, F.coalesce(1 - _sum(F.transform(both, lambda e: e["i"])) / F.nullif(_sum(F.transform(both, lambda e: e["u"])), F.lit(0.0)), F.lit(0.0)))


def change(a: Column, b: Column, weights: tuple[float, float, float, float] = WEIGHTS) -> Column:
    """How much a screen changed, from 0 to 1."""
    unit = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    parts = (unit((1 - structure(a, b)) / 2), unit(bhattacharyya(a, b)), changed(a, b), moved_edges(a, b))
    total = sum(weights)
    return unit(sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0)) / total) if total else F.lit(0.0)


def measured(frames: DataFrame) -> DataFrame:
    """Per frame (recording_id, image_id, ts, grey): its measures, and its change against the frame before in its recording."""
    before = frames.withColumn("_before", F.lag("grey").over(Window.partitionBy("recording_id").orderBy("ts", "image_id")))
    a, b = F.col("_before"), F.col("grey")
    shown = {"brightness": mean(b), "contrast": contrast(b), "sharpness": sharpness(b), "density": density(b), "dominant": dominant(b), "entropy": entropy(b), "score": score(b), "difference": difference(a, b), "changed": changed(a, b), "histogram_distance": bhattacharyya(a, b), "change": change(a, b)}
    return before.select("recording_id", "image_id", *[F.round(x, 5).alias(name) for name, x in shown.items()])


def _grey(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("label").alias("recording_id"), F.col("vec_id").alias("image_id"), F.col("vec_id").cast("double").alias("ts"), F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256 + 128))).cast("int")).alias("grey"))


QUERIES = [
    Built("frame_measures", "F18", ["embeddings"], lambda embeddings: measured(_grey(embeddings)), f"""
WITH g AS (SELECT label AS recording_id, vec_id AS image_id, list_transform(embedding, lambda x : CAST(greatest(0, least(255, floor(CAST(x AS DOUBLE) * 256 + 128))) AS BIGINT)) AS grey FROM embeddings),
w AS (SELECT *, lag(grey) OVER (PARTITION BY recording_id ORDER BY image_id) AS before FROM g),
v AS (SELECT recording_id, image_id, before IS NULL AS first, unnest(grey) AS y, unnest(before) AS x, generate_subscripts(grey, 1) AS i, len(grey) AS n FROM w),
s AS (SELECT *, lag(y) OVER k AS y1, lead(y) OVER k AS y2, lead(x) OVER k AS x2 FROM v WINDOW k AS (PARTITION BY recording_id, image_id ORDER BY i)),
m AS (SELECT recording_id, image_id, any_value(first) AS first, avg(y) AS brightness, stddev_pop(y) AS contrast, var_pop(y1 + y2 - 2 * y) AS sharpness, avg(CASE WHEN y2 IS NULL THEN NULL WHEN abs(y2 - y) > {EDGE} THEN 1.0 ELSE 0.0 END) AS density,
        avg(abs(x - y)) / 255.0 AS difference, avg(CASE WHEN abs(x - y) > {CHANGED} THEN 1.0 ELSE 0.0 END) AS changed, avg(x) AS mx, var_pop(x) AS vx, covar_pop(x, y) AS cov,
        coalesce(1 - sum(CASE WHEN abs(y2 - y) > {EDGE} AND abs(x2 - x) > {EDGE} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN abs(y2 - y) > {EDGE} OR abs(x2 - x) > {EDGE} THEN 1.0 ELSE 0 END), 0), 0) AS moved FROM s GROUP BY recording_id, image_id),
c AS (SELECT recording_id, image_id, y, count(*) AS c, any_value(n) AS n FROM v GROUP BY recording_id, image_id, y),
e AS (SELECT recording_id, image_id, max(c / n) AS dominant, -sum(c / n * log2(c / n)) AS entropy FROM c GROUP BY recording_id, image_id),
hy AS (SELECT recording_id, image_id, y * {BINS} // 256 AS bin, count(*) AS c FROM v GROUP BY ALL), hx AS (SELECT recording_id, image_id, x * {BINS} // 256 AS bin, count(*) AS c FROM v WHERE NOT first GROUP BY ALL),
b AS (SELECT hy.recording_id, hy.image_id, sum(sqrt(CAST(hy.c AS DOUBLE) * hx.c)) AS overlap FROM hy JOIN hx ON hy.recording_id = hx.recording_id AND hy.image_id = hx.image_id AND hy.bin = hx.bin GROUP BY hy.recording_id, hy.image_id),
d AS (SELECT m.*, dominant, entropy, CASE WHEN NOT m.first THEN sqrt(greatest(0, 1 - coalesce(overlap, 0) / (SELECT max(n) FROM v))) END AS hist,
             (2 * mx * brightness + {C1}) * (2 * cov + {C2}) / ((mx * mx + brightness * brightness + {C1}) * (vx + contrast * contrast + {C2})) AS ssim
      FROM m JOIN e USING (recording_id, image_id) LEFT JOIN b USING (recording_id, image_id))
SELECT recording_id, image_id, round(brightness, 5) AS brightness, round(contrast, 5) AS contrast, round(sharpness, 5) AS sharpness, round(density, 5) AS density, round(dominant, 5) AS dominant, round(entropy, 5) AS entropy,
       round(density * 100 + least(entropy, 8.0) * 0.5 + least(sharpness / 1000.0, 3.0), 5) AS score, round(CASE WHEN NOT first THEN difference END, 5) AS difference, round(CASE WHEN NOT first THEN changed END, 5) AS changed, round(hist, 5) AS histogram_distance,
       round(CASE WHEN NOT first THEN least(1.0, greatest(0.0, {WEIGHTS[0]} * least(1, greatest(0, (1 - ssim) / 2)) + {WEIGHTS[1]} * hist + {WEIGHTS[2]} * changed + {WEIGHTS[3]} * moved)) END, 5) AS change FROM d"""),
]
