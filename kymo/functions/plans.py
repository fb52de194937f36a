"""Plans as nested JSON and as flat blocks: one table function, and its twin without Python."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .. import fixtures

BLOCK = "kind string, text string, source_start double, source_end double"
PLAN = f"sections array<struct<blocks: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BLOCK.split(', '))}>>>>"
#: What the table function gives.
FLAT = T.StructType([T.StructField("section_idx", T.IntegerType()), T.StructField("block_idx", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source_start", T.DoubleType()), T.StructField("source_end", T.DoubleType())])


class ExplodePlan:
    """A row for each block of a plan's JSON, in order; a plan that can't be read gives none."""

    def eval(self, plan: str):
        try:
            sections = json.loads(plan or "{}").get("sections") or []
        except (ValueError, AttributeError):
            return
        n = 0
        for k, section in enumerate(sections):
            for b in section.get("blocks") or []:
                yield k, n, b.get("kind"), b.get("text"), b.get("source_start"), b.get("source_end")
                n += 1


def register(spark: SparkSession) -> None:
    """``explode_plan(plan)`` for SQL."""
    spark.udtf.register("explode_plan", udtf(ExplodePlan, returnType=FLAT))


def flat(plans: DataFrame, column: str = "plan") -> DataFrame:
    """The same rows by the JSON reader and two explosions; all other columns stay."""
    keep = [c for c in plans.columns if c != column]
    # the block's number in the plan: its place in its section behind the sizes of the sections before
    sizes = plans.select(*keep, F.from_json(column, PLAN)["sections"].alias("all"))
    before = F.transform("all", lambda s: F.coalesce(F.size(s["blocks"]), F.lit(0)))
    sections = sizes.select(*keep, "all", before.alias("sizes")).select(*keep, "sizes", F.posexplode("all").alias("section_idx", "section"))
    blocks = sections.select(*keep, "section_idx", F.aggregate(F.slice("sizes", F.lit(1), F.col("section_idx")), F.lit(0), lambda a, x: a + x).alias("first"), F.posexplode("section.blocks").alias("i", "b"))
    return blocks.select(*keep, "section_idx", (F.col("first") + F.col("i")).alias("block_idx"), "b.*")


def nested(blocks: DataFrame) -> DataFrame:
    """(plan_id, ``plan``): the JSON of each plan's blocks; a plan's size bounds the row."""
    b = blocks.groupBy("plan_id", "section_idx").agg(F.array_sort(F.collect_list(F.struct("block_idx", "kind", "text", "source_start", "source_end"))).alias("b"))
    s = b.select("plan_id", "section_idx", F.struct(F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["source_start"].alias("source_start"), x["source_end"].alias("source_end"))).alias("blocks")).alias("section"))
    p = s.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "section"))).alias("s"))
    return p.select("plan_id", F.to_json(F.struct(F.transform("s", lambda x: x["section"]).alias("sections"))).alias("plan"))


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan nested as JSON and flattened by the table function."""
    register(spark)
    nested(fixtures.view(spark, sf_dir, "plan_blocks")).createOrReplaceTempView("kymo_nested_plans")
    return spark.sql("SELECT plan_id, e.kind, e.text, e.source_start, e.source_end FROM kymo_nested_plans, LATERAL explode_plan(plan) e")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(nested(fixtures.view(spark, sf_dir, "plan_blocks"))).select("plan_id", "kind", "text", "source_start", "source_end")


def queries() -> dict:
    return {"exploded_plans": _exploded, "flat_plans": _flat}


def oracle_sql() -> dict:
    """Nested and flattened again, plans are the blocks that they were."""
    sql = f"WITH plan_blocks AS ({fixtures.DUCK['plan_blocks']}) SELECT plan_id, kind, text, source_start, source_end FROM plan_blocks"
    return {"exploded_plans": sql, "flat_plans": sql}
