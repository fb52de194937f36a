"""Stages that run again only for what changed: a fingerprint of source, stage and configuration, and a ledger of the work that is done.

A fingerprint is the begin of a SHA-256 over canonical JSON: no spaces, keys in order at every depth, letters as they are. The configuration of a stage is one
nested value of the whole run; sources come as a column. Rows whose fingerprint stands in the ledger of their stage are left out by an anti join.

Cases: a row without a source has the fingerprint of null; repeated rows are worked once each and stand in the ledger once; an empty or missing ledger leaves out
nothing. The ledger is written after the work, so a run that is lost is done again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.query import Built

#: Digits of a fingerprint; the first part of every stage's.
DIGITS, VERSION = 20, 3
LEDGER = "key string, stage string, fingerprint string"


def canonical(value, leave: tuple[str, ...] = ()) -> str:
    """A nested configuration as canonical JSON, without the keys ``leave`` at its top."""
    kept = {k: v for k, v in value.items() if k not in leave} if isinstance(value, dict) else value
    return json.dumps(kept, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def config_fingerprint(config, leave: tuple[str, ...] = ()) -> Column:
    """Of a configuration alone."""
    return F.substring(F.sha2(F.lit(canonical(config, leave)), 256), 1, DIGITS)


def quoted(text: Column) -> Column:
    """A string as JSON; null as null."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    for char, mark in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        escaped = F.regexp_replace(escaped, char, mark)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def stage_fingerprint(source: Column, stage: str, config) -> Column:
    """Of what a stage works on and how: the version, the source's own fingerprint, the stage and its configuration."""
    parts = F.concat(F.lit(f"[{VERSION},"), quoted(source), F.lit(f",{canonical(stage)},{canonical(config)}]"))
    return F.substring(F.sha2(parts, 256), 1, DIGITS)


def open_rows(rows: DataFrame, ledger: DataFrame, stage: str, config, key: str = "key", source: str = "source") -> DataFrame:
    """The rows that a stage has still to do, with their ``fingerprint``."""
    marked = rows.withColumn("fingerprint", stage_fingerprint(F.col(source), stage, config))
    done = ledger.filter(F.col("stage") == stage).select(F.col("key").alias("_key"), F.col("fingerprint").alias("_fingerprint")).distinct()
    return marked.join(done, F.col(key).cast("string").eqNullSafe(F.col("_key")) & (F.col("fingerprint") == F.col("_fingerprint")), "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def incremental(rows: DataFrame, ledger_path: str, stage: str, config, work: Callable[[DataFrame], DataFrame], out_path: str, key: str = "key", source: str = "source") -> int:
    """Run ``work`` over the open rows, append what it gives to ``out_path`` and the rows to the ledger; how many there were."""
    spark = rows.sparkSession
    todo = open_rows(rows, read_ledger(spark, ledger_path), stage, config, key, source)
    marks = todo.select(F.col(key).cast("string").alias("key"), F.lit(stage).alias("stage"), "fingerprint").distinct()
    held = marks.checkpoint() if spark.sparkContext.getCheckpointDir() else marks.persist()  # the ledger changes below
    n = held.count()
    if n:
        work(todo.drop("fingerprint")).write.mode("append").parquet(out_path)
        held.write.mode("append").parquet(ledger_path)
    held.unpersist()
    return n


_CONFIG = {"rewrite": {"model": "large", "beam": 5}, "language": "ar"}
_OLD = {"rewrite": {"model": "small", "beam": 5}, "language": "ar"}


def _open_jobs(job_facts: DataFrame) -> DataFrame:
    """Jobs' latest facts against a ledger of what stood there before: their first fact under the same configuration, or under an older one."""
    latest = job_facts.groupBy("job_key").agg(F.max_by("status", "seq").alias("source"), F.min_by("status", "seq").alias("first"), F.min_by("model", "seq").alias("model"))
    config = lambda c: stage_fingerprint(F.col("first"), "document", c)
    ledger = latest.select(F.col("job_key").alias("key"), F.lit("document").alias("stage"), F.when(F.col("model") == "large", config(_CONFIG)).otherwise(config(_OLD)).alias("fingerprint"))
    return open_rows(latest, ledger, "document", _CONFIG, "job_key").select("job_key", "source", "fingerprint")


QUERIES = [
    Built("open_stages", "F14", ["job_facts"], _open_jobs, f"""
WITH l AS (SELECT job_key, max_by(status, seq) AS source, min_by(status, seq) AS first, min_by(model, seq) AS model FROM job_facts GROUP BY job_key)
SELECT job_key, source, substr(sha256('[{VERSION},"' || source || '","document",{canonical(_CONFIG)}]'), 1, {DIGITS}) AS fingerprint FROM l WHERE source <> first OR model <> 'large'"""),
]
