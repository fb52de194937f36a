"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that it gets. Null texts pass every stage (as a document of
the end token in the last); columns besides id, text and length go through unchanged; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import decontaminate, packing, secrets, simhash, toxicity
from kymo.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine takes for toxic go."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five words a shingle, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    return decontaminate.cut(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the name of their kind."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, in sequences."""
    return packing.pack(docs).drop("ids")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("secrets", secret_spans), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models and walk graphs: SQL can't express them. tests/llm holds each against brute force.
ORACLE_SQL = None
