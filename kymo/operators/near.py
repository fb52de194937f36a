"""Greedy choices over a graph of near rows, in rounds, so that no recording has to fit into a task.

A frame stays if no frame that stays before it is too much like it. Equal signatures are one node, since the first of them decides for all. Two
signatures of ``bits`` bits within ``most`` differing ones share at least one of ``most`` + 1 blocks of bits, so pairs meet by equal blocks and are verified. In each
round a frame without an undecided neighbour before it is decided: it stays unless a neighbour before it stays. Every round is a written table.

Rows without a signature stay (there is nothing to compare); equal positions go by id; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Built
from ..sources.shared import shared_dir

#: Bits of a signature here, and the likeness from which a frame repeats another one.
BITS, LIKE = 60, 0.93


def signature(values: Column, bits: int = BITS) -> Column:
    """A bit for each of the first ``bits`` steps from one value to the next that rises."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get(values, i) > F.get(values, i - 1), F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_pairs(nodes: DataFrame, most: int, bits: int = BITS) -> DataFrame:
    """(``recording_id``, ``a``, ``b``): signatures that differ in ``most`` bits or fewer, the earlier one as ``a``."""
    edges = [bits * k // (most + 1) for k in range(most + 2)]
    blocks = F.array(*[F.col("sig").bitwiseAND(F.lit(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1))) for k in range(most + 1)])
    laid = nodes.select("recording_id", "sig", "place", F.posexplode(blocks).alias("block", "value"))
    left, right = laid.toDF("recording_id", "a", "a_place", "block", "value"), laid.toDF("recording_id", "b", "b_place", "block", "value")
    return left.join(right, ["recording_id", "block", "value"]).filter((F.col("a_place") < F.col("b_place")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).select("recording_id", "a", "b").distinct()


def distinct_frames(frames: DataFrame, like: float = LIKE, bits: int = BITS) -> DataFrame:
    """``frames`` (recording_id, image_id, ts, sig) without those too much like a frame that stays before them."""
    most = max(k for k in range(bits + 1) if k == 0 or 1 - k / bits >= like)
    folder = f"{shared_dir(frames.sparkSession)}/near-{uuid.uuid4().hex}"
    place = F.struct("ts", "image_id")
    nodes = _kept(frames.filter("sig IS NOT NULL").groupBy("recording_id", "sig").agg(F.min(place).alias("place")), folder, "nodes")
    pairs = _kept(near_pairs(nodes, most, bits), folder, "pairs")
    stays = F.col("stays")
    state = nodes.select("recording_id", "sig", F.lit(None).cast("boolean").alias("stays"))
    last, n = -1, 0
    while True:
        before = pairs.join(state.select("recording_id", F.col("sig").alias("a"), stays.alias("a_stays")), ["recording_id", "a"])
        seen = before.groupBy("recording_id", F.col("b").alias("sig")).agg(F.max("a_stays").alias("hit"), F.count_if(F.col("a_stays").isNull()).alias("open"))
        decided = F.when(stays.isNotNull(), stays).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = _kept(state.join(seen, ["recording_id", "sig"], "left").select("recording_id", "sig", decided.alias("stays")), folder, f"round-{n}")
        left, n = state.filter("stays IS NULL").count(), n + 1
        if not left or left == last:
            break
        last = left
    chosen = nodes.join(state.filter("stays"), ["recording_id", "sig"], "left_semi").select("recording_id", F.col("place.image_id").alias("image_id"))
    return frames.join(chosen, ["recording_id", "image_id"], "left_semi").unionByName(frames.filter("sig IS NULL"))


def _of_embeddings(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("label").alias("recording_id"), F.col("vec_id").alias("image_id"), F.col("vec_id").cast("double").alias("ts"), signature(F.col("embedding")).alias("sig"))


QUERIES = [
    Built("distinct_frames", "W22", ["embeddings"], lambda embeddings: distinct_frames(_of_embeddings(embeddings)).select("recording_id", "image_id"), f"""
WITH s AS (SELECT label, vec_id, CAST(list_sum(list_transform(range(1, {BITS} + 1), lambda i : CASE WHEN embedding[i + 1] > embedding[i] THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS sig FROM embeddings),
k AS (SELECT label, list_reduce(list([{{'id': vec_id, 'sig': sig}}] ORDER BY vec_id), lambda kept, x :
  CASE WHEN len(list_filter(kept, lambda y : 1 - bit_count(xor(y.sig, x[1].sig)) / {BITS}.0 >= {LIKE})) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM s GROUP BY label)
SELECT label AS recording_id, k.id AS image_id FROM (SELECT label, unnest(kept) AS k FROM k)"""),
]
