"""Times of rewritten paragraphs, by where their letters stand among the letters of the speech that they were made from.

Paragraphs and spans of a batch are laid on one line of letters: a span ends at the letters up to its end, a paragraph begins at its share of all
letters written. Each paragraph takes the first span that ends at or behind its place and, inside it, the time in proportion. Both lie in one
window of the batch, so no pair of a paragraph and a span is a row.

Without spans a paragraph has no time (null); an empty paragraph counts as a letter; spans without letters give the time of their begin; places past
the last span, by rounding, take its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Built


def paragraph_times(paragraphs: DataFrame, spans: DataFrame, key: str = "recording_id") -> DataFrame:
    """``paragraphs`` (key, paragraph, text) with ``start_s``, from ``spans`` (key, span, start_s, end_s, letters)."""
    run = lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    laid = spans.select(key, "span", F.col("start_s").alias("a"), F.col("end_s").alias("b"), F.col("letters").cast("double").alias("n"))
    laid = laid.withColumn("place", F.sum("n").over(run("span"))).withColumn("n_source", F.sum("n").over(whole))
    written = paragraphs.select(key, "paragraph", F.greatest(F.lit(1), F.length("text")).cast("double").alias("w"))
    written = written.withColumn("share", (F.sum("w").over(run("paragraph")) - F.col("w")) / F.sum("w").over(whole))
    sums = laid.groupBy(key).agg(F.max("n_source").alias("n_source"), F.max_by("b", "span").alias("last"))
    targets = written.join(sums, key, "left").withColumn("place", F.col("share") * F.when(F.col("n_source") == 0, 1.0).otherwise(F.col("n_source")))
    line = targets.select(key, "paragraph", "place", "last", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("span"), F.lit(None).cast("struct<a:double,b:double,n:double,end:double>").alias("s"))
    line = line.unionByName(laid.select(key, F.lit(None).cast(dict(paragraphs.dtypes)["paragraph"]).alias("paragraph"), "place", F.lit(None).cast("double").alias("last"), F.lit(1).alias("kind"), F.col("span").cast("long").alias("span"), F.struct("a", "b", "n", F.col("place").alias("end")).alias("s")))
    ahead = Window.partitionBy(key).orderBy("place", "kind", "span").rowsBetween(0, Window.unboundedFollowing)
    near = F.first("s", ignorenulls=True).over(ahead)
    found = line.withColumn("near", near).filter("kind = 0")
    into = F.when(F.col("near.n") > 0, (F.col("place") - (F.col("near.end") - F.col("near.n"))) / F.col("near.n")).otherwise(0.0)
    at = F.col("near.a") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), into)) * (F.col("near.b") - F.col("near.a"))
    return found.select(key, "paragraph", F.round(F.when(F.col("near").isNotNull(), at).otherwise(F.col("last")), 4).alias("start_s"))


QUERIES = [
    Built("paragraph_times", "W12", ["segments"], lambda segments: paragraph_times(
        segments.select("recording_id", F.col("segment_id").alias("paragraph"), F.substring("text_clean", 1, 90).alias("text")),
        segments.select("recording_id", F.col("segment_id").alias("span"), "start_s", "end_s", F.length("text_raw").alias("letters"))), """
WITH p AS (SELECT recording_id, segment_id AS paragraph, CAST(greatest(1, length(substr(text_clean, 1, 90))) AS DOUBLE) AS w FROM segments),
q AS (SELECT *, (sum(w) OVER (PARTITION BY recording_id ORDER BY paragraph) - w) / sum(w) OVER (PARTITION BY recording_id) AS share FROM p),
s AS (SELECT recording_id, segment_id AS span, start_s, end_s, CAST(length(text_raw) AS DOUBLE) AS n FROM segments),
c AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY span) - n AS walked, sum(n) OVER (PARTITION BY recording_id) AS total FROM s),
m AS (SELECT q.recording_id, q.paragraph, arg_min(start_s + greatest(0.0, least(1.0, CASE WHEN n > 0 THEN (share * total - walked) / n ELSE 0 END)) * (end_s - start_s), span) FILTER (WHERE walked + n >= share * total) AS at, arg_max(end_s, span) AS last
      FROM q JOIN c ON c.recording_id = q.recording_id GROUP BY q.recording_id, q.paragraph)
SELECT recording_id, paragraph, round(coalesce(m.at, last), 4) AS start_s FROM m"""),
]
