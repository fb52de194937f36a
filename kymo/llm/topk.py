"""Exact top-k search by inner product: aggregation over sorted lists without random access.

Components are made whole numbers (``floor(256 * x)``), so every score is exact. Vectors lie in blocks of at most ``BLOCK``
rows; in a block, each component has a list of the rows sorted by it. A query reads the lists of its components
from the end that adds most, some rows at a time. What a row has shown so far, with the least, or what the
list's next entry has, for each component not yet shown, is the lower, or upper, bound of its score. Rows whose upper bound is under the
k-th best lower bound, or under the k-th best score of the blocks before, are out; so are all unread rows once the sum of the next entries
is. Reading stops when few rows are left in, of which the final scores are resolved.

1. Equal vectors are one candidate: only the k + 1 smallest ids of each can be among a query's k best. Every task limits
   them before they are shuffled, so a vector that many rows share is no hot key.
2. Candidates are dealt into blocks and written.
3. The queries are a stated set. They go through in blocks of some ``QUERIES``, each a broadcast of that bound and one pass over the
   candidates; a task gives the k best of its rows for each query, and a window over tasks' bests gives the result. No pair of a query and a row
   that misses a block's best is ever a row.

Cases: rows without an id, vectors that are null or empty or hold a null, a number that is not finite or one of ``LARGEST`` or more in size take no part;
vectors of different lengths never meet; ties go to the smaller id; repeated rows of one id and vector are one row, rows of one id
with different vectors are candidates and queries of their own, never candidates of a query of that id; fewer than
k candidates are all given; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import batch, table, written

K, SCALE = 5, 256
#: Rows of a block of candidates, queries of a pass (about), parts in which a block's lists are read.
BLOCK, QUERIES, PARTS = 16_384, 4096, 16
#: Reading stops when at most one row of a block in so many is left in.
LEFT = 32
#: Size of a component from which a vector takes no part: sums of products stay far inside 64 bits.
LARGEST = 16_384.0


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(``id``, ``v``): vectors of whole numbers, those that take part."""
    v = F.col("_v")
    good = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)) & ~F.isnan(x))
    named = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("_v"))
    return named.filter(good).select("id", F.transform("_v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def candidates(points: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, each once; in partitions of about ``BLOCK`` rows. Written."""
    same = Window.partitionBy("h", "v").orderBy("id")
    few = points.withColumn("h", F.xxhash64("v")).withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= k + 1)
    few = written(few.dropDuplicates(["h", "v", "id"]).select("id", "v"), "distinct")
    n = -(-few.count() // BLOCK)
    return written(few.repartition(max(1, n), F.xxhash64("v")), "candidates")


class Lists:
    """The sorted lists of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.n, self.d = x.shape
        self.order = np.argsort(x.T, axis=1, kind="stable")[:, ::-1].copy()  # of each component, rows by falling value
        self.value = np.take_along_axis(x.T, self.order, 1).astype(np.float64)
        self.slot = self.order * self.d + np.arange(self.d)[:, None]  # where a row's component stands in ``unseen``
        self.unseen = np.empty((self.n, self.d), np.float32)
        self.depth = 0  # how many parts the query before had to read

    def left_in(self, q: np.ndarray, own: int, k: int, bar: float) -> np.ndarray:
        """Rows that may be among the k best of a query; ``bar``: a score that k rows elsewhere reach."""
        n, part = self.n, -(-self.n // PARTS)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        least = np.where(q > 0, self.value[:, -1], self.value[:, 0]) * q
        known, flat = np.zeros(n), self.unseen.ravel()
        flat[:] = 1
        out = self.ids == own
        for k_part, begin in enumerate(range(0, n, part), 1):
            end = min(n, begin + part)
            for dims, read in ((up, slice(begin, end)), (down, slice(n - end, n - begin))):
                if len(dims):
                    known += np.bincount(self.order[dims, read].ravel(), (self.value[dims, read] * q[dims, None]).ravel(), n)
                    flat[self.slot[dims, read].ravel()] = 0
            if end < n and k_part < self.depth:
                continue
            head = np.where(q > 0, self.value[:, min(end, n - 1)], self.value[:, max(0, n - 1 - end)]) * q
            bounds = self.unseen @ np.stack((head, least), 1).astype(np.float32)
            slack = (self.d + 8) * 2.0**-22 * np.maximum(np.abs(head), np.abs(least)).sum()  # what 32-bit sums may be off
            low = np.where(out, -np.inf, known + bounds[:, 1])
            here = max(bar, (np.partition(low, n - k)[n - k] if n >= k else -np.inf) - slack)
            alive = np.flatnonzero((known + bounds[:, 0] >= here - slack) & ~out)
            if len(alive) * LEFT <= n or end == n:
                self.depth = max(1, k_part - 1)
                return alive
        return np.zeros(0, np.int64)

    def best(self, q: np.ndarray, own: int, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of this block and of those ``held``."""
        bar = float(held[0][k - 1]) if len(held[0]) == k else -np.inf
        rows = self.left_in(q.astype(np.float64), own, k, bar)
        scores, ids = np.concatenate((held[0], self.x[rows] @ q)), np.concatenate((held[1], self.ids[rows]))
        first = np.lexsort((ids, -scores))[:k]
        return scores[first], ids[first]


def matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most ``most`` rows, of one length each time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    count: dict[int, int] = {}

    def taken(d: int) -> tuple[np.ndarray, np.ndarray]:
        count[d] = 0
        parts = held.pop(d)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for b in batches:
        ids, vectors = b.column(0).to_numpy(), b.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy().astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            for begin in range(0, len(rows), most):
                some = rows[begin : begin + most]
                if count.get(d, 0) + len(some) > most:
                    yield taken(d)
                held.setdefault(d, []).append((ids[some], flat[begins[some][:, None] + np.arange(d)]))
                count[d] = count.get(d, 0) + len(some)
    for d in list(held):
        yield taken(d)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's id, ``score``: the k best rows of ``vectors`` for each row of ``queries``, its own id left out."""
    spark = vectors.sparkSession
    found = candidates(whole(vectors, id_col, vector_col, scale), k)
    asked = written(whole(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"]).withColumn("query", F.monotonically_increasing_id()), "queries")
    n_blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("query"), F.lit(n_blocks))
    path = f"{shared_dir(spark)}/best-{uuid.uuid4().hex}"
    schema = "query long, query_id long, vec_id long, score long"
    for b in range(n_blocks):  # a pass for every QUERIES queries
        rows = asked.filter(block == b).collect()  # about QUERIES rows
        held = spark.sparkContext.broadcast(_by_length(rows))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {d: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names) for d, (names, _, _) in held.value.items()}
            for ids, x in matrices(batches, BLOCK):
                if x.shape[1] in best:
                    lists, (_, owns, qs) = Lists(ids, x), held.value[x.shape[1]]
                    best[x.shape[1]] = [lists.best(q, own, k, one) for q, own, one in zip(qs, owns, best[x.shape[1]], strict=True)]
            for d, (names, owns, _) in held.value.items():
                n = [len(one[0]) for one in best[d]]
                if sum(n):
                    yield batch(schema, [np.repeat(names, n), np.repeat(owns, n), np.concatenate([one[1] for one in best[d]]), np.concatenate([one[0] for one in best[d]])])

        found.mapInArrow(run, schema).write.mode("append").parquet(path)
        held.unpersist()
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _by_length(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each vector length: queries, their ids, their vectors."""
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r.v), []).append(r)
    return {d: (np.array([r.query for r in some]), np.array([r.id for r in some]), np.array([r.v for r in some], np.int64)) for d, some in found.items()}


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))


OP12_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
