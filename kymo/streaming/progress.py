"""Progress of transcripts as their segments arrive.

A recording is announced with its duration; its segments come later. Both streams meet in an interval join (a segment counts from its recording's
announcement on, for at most ``LONGEST``), so neither side's state grows for ever. Behind it each recording has one row, that a
micro-batch updates: segments, spoken seconds, words, coverage, pace and how far the recording is done. The row's state goes when the watermark passes
the recording's announcement by ``LONGEST``.

A join gives rows once and an aggregation gives updates, which one streaming query can't do both of. So there are two: the first
writes what it joins to a table, the second reads that table as a stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..plans.query import with_views
from ..sources.shared import shared_dir

#: The longest recording, and how late rows may be.
LONGEST, LATE = "12 hours", "10 minutes"
#: When the given recordings are taken to begin: 2024, in seconds.
BEGAN = 1_704_067_200


def met(segments: DataFrame, announced: DataFrame) -> DataFrame:
    """Segments (recording_id, segment_id, start_s, end_s, n_words, ts) with their recording's ``announced_at`` and ``duration_s``."""
    left = segments.withWatermark("ts", LATE).alias("s")
    right = announced.withWatermark("announced_at", LATE).alias("a")
    inside = F.expr(f"s.recording_id = a.recording_id AND s.ts >= a.announced_at AND s.ts <= a.announced_at + INTERVAL {LONGEST}")
    return left.join(right, inside).select("s.*", "a.announced_at", "a.duration_s")


def progress(rows: DataFrame) -> DataFrame:
    """One row for each recording over what ``met`` gives; a stream gives its changes (update mode)."""
    if rows.isStreaming:
        rows = rows.withWatermark("announced_at", LONGEST)
    spoken = F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")))
    a = rows.groupBy("recording_id", "announced_at", "duration_s").agg(F.count(F.lit(1)).alias("segments"), spoken.alias("spoken"), F.sum("n_words").alias("words"), F.max("end_s").alias("done_s"))
    share = lambda x: F.round(F.least(F.lit(100.0), 100.0 * x / F.nullif("duration_s", F.lit(0.0))), 4)
    pace = F.round(60.0 * F.col("words") / F.nullif("done_s", F.lit(0.0)), 4)
    return a.select("recording_id", "segments", share(F.col("spoken")).alias("coverage_percent"), F.col("words").cast("long").alias("words"), pace.alias("words_per_minute"), share(F.col("done_s")).alias("progress_percent"))


def run(spark: SparkSession, segments: DataFrame, announced: DataFrame, parts: int = 2) -> DataFrame:
    """Every update of ``progress``, with the number of its micro-batch (``update``), as the segments come in ``parts`` by their time.

    Each part starts both queries again from their checkpoints.
    """
    folder = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    t = F.unix_micros("ts")
    low, high = segments.agg(F.min(t), F.max(t)).first()
    edges = [low + (high - low) * k // parts for k in range(1, parts)] if low is not None else []
    sink = lambda rows, batch: rows.withColumn("update", F.lit(batch)).write.mode("append").parquet(f"{folder}/updates")
    announced.write.parquet(f"{folder}/announced")
    joined = met(segments, announced)
    for k in range(parts):
        after = t > edges[k - 1] if k else F.lit(True)
        segments.filter(after & (t <= edges[k] if k < len(edges) else F.lit(True))).write.mode("append").parquet(f"{folder}/segments")
        source = lambda name, schema: spark.readStream.schema(schema).parquet(f"{folder}/{name}")
        first = met(source("segments", segments.schema), source("announced", announced.schema))
        first.writeStream.format("parquet").option("path", f"{folder}/met").option("checkpointLocation", f"{folder}/met-state").trigger(availableNow=True).start().awaitTermination()
        second = progress(source("met", joined.schema))
        second.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress-state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    schema = progress(joined).withColumn("update", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{folder}/updates")


def last(updates: DataFrame) -> DataFrame:
    """The last update of each recording."""
    columns = [c for c in updates.columns if c != "update"]
    return updates.groupBy("recording_id").agg(*[F.max_by(c, "update").alias(c) for c in columns if c != "recording_id"]).select(*columns)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of the given conversations, timed by when they end, and the announcements of their recordings."""
    seen = fixtures.view(spark, sf_dir, "segments").select("recording_id", "segment_id", "start_s", "end_s", "n_words", F.timestamp_micros(((F.col("end_s") + BEGAN) * 1e6).cast("long")).alias("ts"))
    return seen, seen.groupBy("recording_id").agg(F.max("end_s").alias("duration_s")).select("recording_id", "duration_s", F.timestamp_seconds(F.lit(BEGAN)).alias("announced_at"))


def coverage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last(run(spark, *sources(spark, sf_dir)))


def queries() -> dict:
    return {"coverage_stream": coverage_stream}


def oracle_sql() -> dict[str, str]:
    return {
        "coverage_stream": with_views(["segments"], """
SELECT recording_id, count(*) AS segments, round(least(100.0, 100.0 * sum(greatest(0.0, end_s - start_s)) / nullif(max(end_s), 0)), 4) AS coverage_percent, CAST(sum(n_words) AS BIGINT) AS words,
       round(60.0 * sum(n_words) / nullif(max(end_s), 0), 4) AS words_per_minute, CASE WHEN max(end_s) > 0 THEN 100.0 END AS progress_percent FROM segments GROUP BY recording_id"""),
    }
