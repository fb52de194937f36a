"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint has a bit where more than half of its shingles' hashes have it. Equal fingerprints are one
class. Classes meet in groups that any two fingerprints within the limit must share: with b blocks of bits and a limit of
k, at least b - k blocks are equal, so each choice of b - k blocks is a table of groups. How many blocks are used follows
from the number of classes and keeps groups short at any size; every choice is exact. Inside a group each class has its
Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality a pair whose coordinates differ by
more than the limit anywhere can't be a link; the table is searched in order of its first coordinate, the others discard
pairs one after another, and the survivors are verified by their exact distance. Groups of any size are compared whole.

Cases: null, empty and white-space texts have fingerprint zero and link like any other; texts of fewer words than a
shingle have one shingle; repeated rows share a class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, discard, table, utf8, written
from .components import Forest, components, links_in_groups

WORDS, BITS, SEED = 4, 4, 42
PIVOTS = 16
#: A name that no table has.
_ROW = "__kymo_row"
_BLOCK = 1 << 14
#: Of ``similar``: smallest hashes that make its groups; hashes by which pairs are proposed (all of a text of that many
#: shingles or fewer); what an estimate from so many may be off (five standard deviations at 0.8); bits that fingerprints
#: of similar texts may differ in.
KEYS, SKETCH, SLACK, WIDE_BITS = 5, 256, 0.125, 20
_MIXERS = [int(x) for x in np.random.default_rng(11).integers(1, 1 << 63, 16, np.int64)]
#: Reference fingerprints: fixed by this seed, the same in every task.
_PIVOT_VALUES = np.random.default_rng(7).integers(0, 1 << 64, PIVOTS, np.uint64)
#: (blocks, equal blocks, most classes): the first row whose third value isn't exceeded is used.
_SCHEMES = ((5, 1, 400_000), (6, 2, 100_000_000), (7, 3, 6_000_000_000), (8, 4, 1 << 62))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[at : min(n, at + _BLOCK)], ends[at + min(words, len(tokens)) - 1 :])], np.uint64)  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, ``row``, ``fp``): a hash of id and text, and the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in byte_values(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=[id_col, "row", "fp"])

    return docs.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("row"), utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, row long, fp long")


def _linked(limit: int):
    """Joins fingerprints of one group that differ in ``limit`` bits or fewer."""

    def link(columns: list) -> Forest:
        fps = columns[0].to_numpy().view(np.uint64)
        forest = Forest(len(fps))
        if len(fps) == 2:
            if int(fps[0] ^ fps[1]).bit_count() <= limit:
                forest.join(0, 1)
            return forest
        distances = np.bitwise_count(fps[:, None] ^ _PIVOT_VALUES[None, :]).astype(np.int8)
        order = np.argsort(distances[:, 0], kind="stable")
        fps, distances = fps[order], np.ascontiguousarray(distances[order].T)
        reach = np.searchsorted(distances[0], distances[0] + limit, side="right")
        for a in range(len(fps) - 1):
            near = np.arange(a + 1, reach[a])
            for d in distances[1:]:
                if len(near) < 16:
                    break
                near = near[np.abs(d[near] - d[a]) <= limit]
            near = near[np.bitwise_count(fps[near] ^ fps[a]) <= limit]
            for b in near.tolist():
                forest.join(int(order[a]), int(order[b]))
        return forest

    return link


def tables(classes: DataFrame, limit: int = BITS) -> DataFrame:
    """(``t``, ``key``, ``fp``): every class once in each table of groups."""
    n = classes.count()
    blocks, equal = next((b, e) for b, e, most in _SCHEMES if n <= most) if limit == BITS else (limit + 1, 1)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen) for chosen in combinations(range(blocks), equal)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return classes.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"), "fp")


def grouped(prints: DataFrame, id_col: str, limit: int = BITS) -> DataFrame:
    """(``fp``, ``label``, ``component_id``) of every fingerprint: its component, and the smallest id in it. Written."""
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    linked = components(links_in_groups(tables(classes.select("fp"), limit), ["t", "key"], "fp", ["fp"], _linked(limit)))
    named = written(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    ids = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "ids")
    out = written(named.join(ids, "label").select("fp", "label", "component_id"), "by_print")
    for done in (classes, linked, named, ids):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: int = BITS, seed: int = SEED) -> DataFrame:
    """Per document: id, ``fp``, ``component_id`` (the smallest id that links reach, its own included)."""
    prints = written(fingerprints(docs, id_col, text_col, words, seed).drop("row"), "fingerprints")
    return prints.join(grouped(prints, id_col, limit), "fp").select(id_col, "fp", "component_id")


def sketch(text: bytes, words: int, keys: int = KEYS, size: int = SKETCH) -> tuple[int, int, list[int], bytes, bytes]:
    """Hash of the words, fingerprint of the distinct shingles, their smallest hash under each of ``keys`` functions, the ``size`` smallest hashes, and the others.

    Of the hashes in the last two, 32 bits are kept: of a million shingles, about one in ten thousand then equals another.
    """
    tokens = text.lower().split()
    joined = memoryview(b" ".join(tokens))
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    if not tokens:
        return digest(b"", SEED), 0, [0] * keys, np.zeros(1, np.uint32).tobytes(), b""
    hashes = np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[min(words, len(tokens)) - 1 :])), np.uint64, n))  # noqa: B905
    least = [int(((hashes ^ np.uint64(m)) * np.uint64(m | 1)).min()) for m in _MIXERS[:keys]]
    places = (np.array(least, np.uint64) + np.arange(keys, dtype=np.uint64)).view(np.int64).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])
    short = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return digest(joined, SEED), fp, places, short[:size].tobytes(), short[size:].tobytes()


def _similar(least: float, bits: int):
    """Joins texts of a group of a Jaccard of ``least`` or more, exactly if both sets are whole, else with a safe margin. Pairs of pivot distances or fingerprints over ``bits`` apart are discarded first; those already joined aren't compared."""

    def link(columns: list) -> Forest:
        fps = columns[0].to_numpy().view(np.uint64)
        sets = [np.frombuffer(x, np.uint32) for x in columns[1].to_pylist()]
        whole = columns[2].to_pylist()
        distances = np.bitwise_count(fps[:, None] ^ _PIVOT_VALUES[None, :]).astype(np.int8)
        sizes = np.array(list(map(len, sets)))
        whole = np.array(whole, bool)
        forest = Forest(len(fps))
        label = np.arange(len(fps))
        for a in range(1, len(fps)):
            near = np.flatnonzero(np.abs(distances[:a] - distances[a]).max(axis=1) <= bits)
            near = near[np.bitwise_count(fps[near] ^ fps[a]) <= bits]
            both_whole = whole[near] & whole[a]
            near = near[~both_whole | (np.minimum(sizes[near], sizes[a]) >= least * np.maximum(sizes[near], sizes[a]))]
            near = near[label[near] != label[a]]
            while len(near):
                b, near = int(near[0]), near[1:]
                full = bool(whole[a] and whole[b])
                if jaccard(sets[a], sets[b], full) >= least - (0 if full else SLACK):
                    forest.join(a, b)
                    label[label == label[b]] = label[a]
                    near = near[label[near] != label[a]]
        return forest

    return link


def jaccard(a: np.ndarray, b: np.ndarray, whole: bool) -> float:
    """Of two sorted sets of hashes; of sketches, over the smallest hashes that both would show."""
    if not whole:
        top = min(a[-1] if len(a) >= SKETCH else np.iinfo(np.uint32).max, b[-1] if len(b) >= SKETCH else np.iinfo(np.uint32).max)
        a, b = a[a <= top], b[b <= top]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bits: int = WIDE_BITS) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates by shingle similarity: rows (id, ``row``, ``th``), and (``node``, ``label``) of linked texts ``th``. Written.

    A limit of few bits finds only copies that are almost whole: at a Jaccard of 0.8, fingerprints differ in about ten
    bits. So texts meet in groups by their smallest shingle hashes (all but 0.2**KEYS of the pairs at 0.8 share one), pivot
    distances and fingerprints of the distinct shingles discard pairs too far apart, and the survivors are linked by the
    Jaccard of their shingles. Where a text has more than ``SKETCH`` shingles that is only a proposal, from the smallest
    hashes and with a margin: the components of proposed links are linked again, by the Jaccard of whole sets.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th, fps, keys, sets, rest = zip(*(sketch(t, words) for t in byte_values(b.column(2))), strict=True) if b.num_rows else ((), (), (), (), ())
            th, fps = (np.array(x, np.uint64).view(np.int64) for x in (th, fps))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(th), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(rest, pa.binary())], names=[id_col, "row", "th", "fp", "keys", "hashes", "rest"])

    rows = docs.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("row"), utf8(text_col).alias("bytes"))
    prints = written(rows.mapInArrow(run, f"`{id_col}` {kind}, row long, th long, fp long, keys array<long>, hashes binary, rest binary"), "sketches")
    keyed = written(prints.select("th", "keys").dropDuplicates(["th"]).select("th", F.explode("keys").alias("key")), "keys")  # copies are one text
    met = keyed.groupBy("key").agg(F.min("th").alias("low"), F.max("th").alias("high")).filter("low <> high").select("key")
    found = written(keyed.join(met, "key", "left_semi").select("th", "key"), "met")
    discard(keyed)
    texts = prints.select("th", "fp", "hashes", "rest").join(found.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    members = written(texts.withColumn("whole", F.length("rest") == 0), "members")
    met_again = written(found.join(members.drop("rest"), "th"), "meetings")
    proposed = components(links_in_groups(met_again, ["key"], "th", ["fp", "hashes", "whole"], _similar(least, bits), tile=4096))
    discard(met_again)
    sized = members.select(F.col("th").alias("node"), "whole").join(proposed, "node")
    unsure = written(sized.groupBy("label").agg(F.every("whole").alias("whole")).filter("NOT whole").select("label"), "unsure")
    sure = proposed.join(unsure, "label", "left_anti").select("node", "label")
    again = members.join(proposed.join(unsure, "label").select(F.col("node").alias("th"), "label"), "th")
    again = written(again.select("label", "th", "fp", F.concat("hashes", "rest").alias("hashes"), F.lit(True).alias("whole")), "whole")
    verified = components(links_in_groups(again, ["label"], "th", ["fp", "hashes", "whole"], _similar(least, bits)))
    discard(again)
    linked = written(sure.unionByName(verified.select("node", "label")), "linked")
    for done in (found, members, proposed, unsure, verified):
        discard(done)
    return prints.select(id_col, "row", "th"), linked


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id (a null is smallest)."""
    rows, linked = similar(docs, id_col, text_col, words, least)
    named = rows.join(linked.withColumnRenamed("node", "th"), "th", "left").withColumn("label", F.coalesce("label", "th"))
    first = named.groupBy("label").agg(F.min(F.struct(id_col, "row")).alias("first"))
    kept = written(first.select(F.col("first.row").alias(_ROW)).distinct(), "kept")
    return docs.withColumn(_ROW, F.xxhash64(id_col, text_col)).join(kept, _ROW, "left_semi").dropDuplicates([_ROW, id_col]).drop(_ROW)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
