"""Links inside groups, and connected components, without a hub, a pair list or a group that one task must hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, whole_groups, written

#: Members of a group that one task compares with each other; larger groups are cut into tiles, each pair of tiles a task's work.
TILE = 2048


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple[int, int]]:
        """A binary tree over each set of two or more: it joins the same members, and none has more than three edges."""
        sets: dict[int, list[int]] = {}
        for x in range(len(self.parent)):
            sets.setdefault(self.root(x), []).append(x)
        for members in sets.values():
            for k in range(1, len(members)):
                yield members[(k - 1) // 2], members[k]


def _tiled(large: DataFrame, node: str) -> DataFrame:
    """Rows of groups that are cut into ``_tiles``, each in all pairs (``_i``, ``_j``) of its tile with another."""
    own = F.pmod(F.xxhash64(node), F.col("_tiles")).cast("int")
    large = large.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return large.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_own", "_other", "_tiles")


def links_in_groups(rows: DataFrame, keys: list[str], node: str, payload: list[str], link: Callable[[list[np.ndarray | list]], Forest], tile: int = TILE) -> DataFrame:
    """Edges (``u``, ``v``) that join what ``link`` joins inside each group of ``rows`` by ``keys``.

    ``link`` gets the payload columns of at most two tiles of one group. Groups of one row are no work; every pair of
    members of a larger group meets in some tile pair, so nothing is capped. ``node`` (a long) is unique in its group.
    """
    kind = dict(rows.dtypes)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    small = rows.join(counts.filter(F.col("_n") <= tile), keys, "left_semi").withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    tiles = F.ceil(F.col("_n") / (tile // 2)).cast("int")
    large = _tiled(rows.join(counts.filter(F.col("_n") > tile).withColumn("_tiles", tiles).drop("_n"), keys), node)
    order = [*keys, "_i", "_j"]
    dealt = small.unionByName(large).select(*order, node, *payload).repartition(*order).sortWithinPartitions(*order, node)
    n_keys = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for g in groups(batches, order):
            if g.num_rows < 2:
                continue
            ids = g.column(n_keys).to_numpy()
            found = link([g.column(n_keys + 1 + k) for k in range(len(payload))])
            for a, b in found.edges():
                us.append(ids[a])
                vs.append(ids[b])
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    assert kind[node] == "bigint"
    return dealt.mapInArrow(run, "u long, v long").distinct()


def links_of_many_groups(rows: DataFrame, keys: list[str], node: str, payload: str, link: Callable[[np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray]], most: int) -> DataFrame:
    """As ``links_in_groups``, for small groups by the million: ``link`` gets the group of each row and the payload, and gives edges of rows.

    Only groups of more than ``most`` bytes of payload, of which there are few, are looked up and cut into tiles; all others go through one shuffle.
    """
    large = F.broadcast(heavy(rows, keys, payload, most).withColumn("_tiles", F.ceil(2 * F.col("_bytes") / most).cast("int")).select(*keys, "_tiles"))
    small = rows.join(large, keys, "left_anti").withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    order = [*keys, "_i", "_j"]
    dealt = small.unionByName(_tiled(rows.join(large, keys), node)).select(*order, node, payload).repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, order):
            a, b = link(number, table.column(payload).combine_chunks())
            ids = table.column(node).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["u", "v"])

    assert dict(rows.dtypes)[node] == "bigint"
    return dealt.mapInArrow(run, "u long, v long").distinct()


def heavy(rows: DataFrame, keys: list[str], payload: str, most: int) -> DataFrame:
    """Groups of more than ``most`` bytes of payload, with their rows and bytes."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length(payload)).alias("_bytes")).filter(F.col("_bytes") > most)


def trees(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a binary tree over each set of rows, of 0 to ``n``, that the edges ``a``, ``b`` connect."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    order = np.argsort(label, kind="stable")
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(np.concatenate(([True], label[order][1:] != label[order][:-1])), at, 0)) if n else at
    below = at > head
    return order[head[below] + (at - head - 1)[below] // 2], order[below]


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(``node``, ``label``) for every end of an edge; the label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label's own label, so a chain of n
    nodes takes about log2(n) rounds. Every round is a written table; the join on labels is one that Spark can split.
    """
    both = written(edges.union(edges.select("v", "u")).toDF("u", "v").filter("u <> v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        hooked = written(labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(hooked.join(up, "label").select("node", F.col("up").alias("label"), F.col("old")), "labels")
        changed = jumped.filter("label <> old").limit(1).count()
        discard(labels)
        discard(hooked)
        labels = jumped.drop("old")
        labels._kymo_path = jumped._kymo_path
        if not changed:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
