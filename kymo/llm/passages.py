"""Substring deduplication: MinHash banding over paragraphs, and over pieces that their content cuts.

Paragraphs are lines of ``LEAST`` words or more, and blocks of shorter lines in a row that have as many together. Passages
are also pasted into the middle of other text, so the words of a document, across its lines, are cut too: after each word pair
whose hash is the smallest among ``RADIUS`` pairs on either side. A shared passage is cut the same way wherever it stands.
Pieces have ``LEAST_UNIT`` words or more. Each unit has a MinHash of its five-word shingles under some functions, each a band of
one row: a pair of a Jaccard of 0.8 meets in some band with 1 - 0.2**bands. Paragraphs have ``PARAGRAPH_BANDS`` (0.9997),
pieces ``BANDS``: a passage has several of them, equal ones always meet.

1. Every band key is looked for a second time, in parts by its last bits. Up to ``BITMAP_KEYS`` keys met twice or more set bits of a
   bitmap that is broadcast (at most one bit in eight is set; a key may be let through by chance, never held back); more
   of them meet the units in a shuffle.
2. Units with such a key are kept with their shingles; equal ones are one class.
3. Classes that share a key are compared by exact Jaccard: pairs that share one of their rarest shingles (``class_links``: groups of any size).
4. Connected components over classes; a component in two or more documents repeats. Neighbouring repeated units of a
   document are one span. A gap of up to ``BRIDGE`` words, as a changed word leaves, is bridged where the units on both
   sides were first seen in one document at one distance; of such a span ``COVERED`` must be repeated units. Spans of fewer
   than ``LEAST`` words, with the context that their cuts prove, are left alone. The first occurrence (smallest id, then
   position) of a component stays.

Cases: null, empty and short texts have no units; copies of a document repeat all its passages; repeated rows with the
same id count as one document, each row without an id as a document of its own, behind all others (``component_id`` is null
where all of a component have none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_values, discard, groups, table, utf8, written
from .components import Forest, components, heavy, links_of_many_groups, trees

SHINGLE, RADIUS, BANDS, PARAGRAPH_BANDS, JACCARD = 5, 4, 2, 5, 0.8
LEAST_UNIT, LEAST, BRIDGE, COVERED = 5, 30, 32, 0.45
#: Bits of the least and the largest bitmap of repeated keys (16 and 128 MB), and the keys that the largest takes.
SLOTS, MOST_SLOTS = 27, 30
BITMAP_KEYS = 1 << MOST_SLOTS >> 3
#: Bytes of a block of a text, of texts that are cut together, shingles that are compared at once, rows of one shingle that are compared by pairs.
_BLOCK, _TOGETHER = 1 << 19, 1 << 18
_COMPARED, _DENSE = 1 << 20, 64
#: Bytes of the shingles of a group that one task compares.
GROUP = 1 << 21
#: Parts of the keys, by their last bits; one part's keys are sorted at a time.
PARTS = 1 << 10
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


class _Powers:
    """Powers of the base and its inverse, for substring hashes of a block."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            full = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b))), dtype=np.uint64)
            cls.up, cls.down = full(_BASE), full(_INVERSE)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[k % 3] + np.uint64(k)
    x = (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 3]
    return x ^ (x >> np.uint64(29))


def blocks(text: bytes) -> Iterator[bytes]:
    """Lower-case text in blocks that end at white space; a block bounds memory for texts of any length."""
    start = 0
    while start < len(text):
        end = min(len(text), start + _BLOCK)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[start:end].lower()
        start = end


def laid(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Blocks of one or more texts, some ``_TOGETHER`` bytes or one block, with the number of each one's text."""
    rows, held, size = [], [], 0
    for k, text in enumerate(texts):
        for block in blocks(text):
            rows.append(k)
            held.append(block)
            size += len(block)
            if size >= _TOGETHER:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def _smallest(padded: np.ndarray, at: np.ndarray, shifts: range) -> np.ndarray:
    out = padded[at + shifts[0]]
    for k in shifts[1:]:
        np.minimum(out, padded[at + k], out=out)
    return out


def units(texts: list[bytes], radius: int = RADIUS) -> list[dict[str, np.ndarray]]:
    """Pieces and paragraphs of some lower-case texts; nothing goes from one text to the next.

    Each: ``text`` (its number), ``first`` and ``last`` word (exclusive), ``left`` and ``right`` (no cut that proves more
    context), ``uid``, ``keys``, ``offsets`` and ``count`` of its ``shingles``. ``base`` is the number of words of each text.
    """
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    white = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return [{"base": np.zeros(len(texts), np.int64)}]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    base = np.bincount(text, minlength=len(texts))
    begin_of = np.concatenate(([0], np.cumsum(base)[:-1]))  # first word of each text
    ends_text = np.concatenate((text[1:] != text[:-1], [True]))
    # words joined by one space each: positions of the words in that text
    width = ends - starts
    at = np.concatenate(([0], np.cumsum(width + 1)[:-1]))
    joined = np.full(int(at[-1] + width[-1]), 32, np.uint8)
    joined[np.repeat(at - starts, width) + np.flatnonzero(~white)] = raw[~white]
    up, down = _Powers.of(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    hashed = lambda a, b: (sums[at[b] + width[b]] - sums[at[a]]) * down[at[a]]  # words a..b, both included
    index = np.arange(n)
    pair = mix(hashed(index, index + ~ends_text), 0)
    place = index + (text + 1) * (radius + 1)  # between texts there are more places than a window reaches
    padded = np.full(int(place[-1]) + radius + 2, _MOST, np.uint64)
    padded[place] = pair
    cut = (pair < _smallest(padded, place, range(-radius, 0))) & (pair == _smallest(padded, place, range(radius + 1)))  # the first of equals
    lines = np.cumsum(raw == 10)
    breaks = np.concatenate((lines[starts[1:]] - lines[ends[:-1] - 1], [2]))  # line ends between a word and the next
    breaks[ends_text] = 2

    def made(begins: np.ndarray, stops: np.ndarray, least: int, bands: int, first_band: int, proves: bool) -> dict[str, np.ndarray]:
        keep = stops - begins >= least
        begins, stops = begins[keep], stops[keep]
        if not len(begins):
            return {}
        count = stops - begins - SHINGLE + 1
        offsets = np.concatenate(([0], np.cumsum(count)[:-1]))
        first = np.repeat(begins - offsets, count) + np.arange(int(count.sum()))
        shingles = mix(hashed(first, first + SHINGLE - 1), 1)
        keys = [np.minimum.reduceat(mix(shingles, 2 + k), offsets) ^ np.uint64(k) for k in range(first_band, first_band + bands)]
        left = np.ones(len(begins), bool) if not proves else begins == begin_of[text[begins]]
        right = np.ones(len(begins), bool) if not proves else ends_text[stops - 1]
        own = begin_of[text[begins]]
        return {"text": text[begins], "first": begins - own, "last": stops - own, "left": left, "right": right, "uid": mix(hashed(begins, stops - 1), 9).view(np.int64), "keys": np.stack(keys).view(np.int64), "offsets": offsets, "count": count, "shingles": (shingles >> np.uint64(32)).astype(np.uint32)}

    stops = np.flatnonzero(cut | ends_text) + 1
    pieces = made(np.concatenate(([0], stops[:-1])), stops, LEAST_UNIT, BANDS, 0, True)
    line_stops = np.flatnonzero(breaks > 0) + 1
    line_begins = np.concatenate(([0], line_stops[:-1]))
    short = line_stops - line_begins < LEAST
    apart = np.concatenate(([True], (breaks[line_stops[:-1] - 1] > 1) | ~short[1:] | ~short[:-1]))  # does a block begin here?
    heads = np.flatnonzero(apart)
    paragraphs = made(line_begins[heads], line_stops[np.append(heads[1:], len(line_stops)) - 1], LEAST, PARAGRAPH_BANDS, BANDS, False)
    return [{"base": base}, *(u for u in (pieces, paragraphs) if u)]


def _linked(least: float):
    """Joins the paragraphs of a group that have a Jaccard of ``least`` or more; those already joined aren't compared."""

    def link(columns: list) -> Forest:
        sets = [frozenset(np.frombuffer(x, np.uint32).tolist()) for x in columns[0].to_pylist()]
        forest = Forest(len(sets))
        roots: list[list[int]] = []
        for a, s in enumerate(sets):
            joined = []
            for members in roots:
                for b in members:
                    t = sets[b]
                    if min(len(s), len(t)) >= least * max(len(s), len(t)) and (both := len(s & t)) >= least * (len(s) + len(t) - both):
                        forest.join(a, b)
                        joined.append(members)
                        break
            if not joined:
                roots.append([a])
                continue
            joined[0].append(a)
            for more in joined[1:]:
                joined[0].extend(more)
                roots.remove(more)
        return forest

    return link


def _sets(shingles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of the distinct shingles of each row, in order."""
    ends = np.frombuffer(shingles.buffers()[1], np.int32)[shingles.offset : shingles.offset + len(shingles) + 1] >> 2
    values = np.frombuffer(shingles.buffers()[2], np.uint32, count=int(ends[-1]))[ends[0] :]
    both = np.sort(np.repeat(np.arange(len(shingles), dtype=np.uint64) << np.uint64(32), np.diff(ends)) | values)
    distinct = both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]
    return (distinct >> np.uint64(32)).astype(np.int64), distinct & np.uint64(0xFFFFFFFF)


def _needed(size: np.ndarray, least: float) -> np.ndarray:
    """Shingles that a set of ``size`` shares with any set of a Jaccard of ``least`` or more."""
    return np.ceil(least * size - 1e-6).astype(np.int64)


def _ranked(rank: np.ndarray, row: np.ndarray, value: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Places of the first ``slots`` of each row by rank, then value."""
    order = np.lexsort((value, rank, row))
    begins = np.searchsorted(row[order], np.arange(len(slots)))
    return order[np.arange(len(order)) - begins[row[order]] < slots[row[order]]]


def _pairs(number: np.ndarray, row: np.ndarray, value: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pairs of rows of a group that can have a Jaccard of ``least``, and rows of a group of which any may, too many for a list of pairs.

    In any order of shingles, two such sets share one among the first of each, all but ``_needed`` less one. Rarest first, few share one.
    """
    need, alive = _needed(size, least), np.ones(len(size), bool)
    for _ in range(2):  # what is left counts again: shingles are rarer without the rows that have no like
        keep = alive[row]
        row, value = row[keep], value[keep]
        key = (number[row].astype(np.uint64) << np.uint64(32)) | value
        order = np.argsort(key)
        begins = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) > 0))[: len(key)])
        many = np.empty(len(key), np.int64)
        many[order] = np.repeat(np.diff(begins, append=len(key)), np.diff(begins, append=len(key)))
        shared = np.bincount(row[many > 1], minlength=len(size))
        alive &= shared >= need
    keep = (many > 1) & alive[row]
    row, key, many = row[keep], key[keep], many[keep]
    first = _ranked(many, row, key, np.maximum(shared - need + 1, 0))
    order = first[np.lexsort((row[first], key[first]))]
    key, row = key[order], row[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(begins, len(key)))
    many = np.flatnonzero(np.bincount(row[np.repeat(length > _DENSE, length)], minlength=len(size)))  # rows of such runs, once: copies share many
    dense = [rows for rows in np.split(many, np.flatnonzero(np.diff(number[many])) + 1) if len(rows)]
    left = np.repeat(np.where(length > _DENSE, 0, begins + length), length) - np.arange(len(key)) - 1  # others behind in its run
    at, found = np.arange(len(key)), []
    for d in range(1, _DENSE):
        at = at[left[at] >= d]
        if not len(at):
            break
        found.append(row[at] * len(size) + row[at + d])
    met = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
    a, b = np.divmod(met[np.diff(met, prepend=-1) > 0], max(1, len(size)))
    close = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
    return a[close], b[close], dense


def _alike(a: np.ndarray, b: np.ndarray, value: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a Jaccard of ``least`` or more; ``value`` holds the sets one behind the other."""
    start = np.cumsum(size) - size
    out = np.zeros(len(a), bool)
    cost = np.cumsum(size[a] + size[b])
    cuts = np.searchsorted(cost, np.arange(_COMPARED, int(cost[-1]) + _COMPARED, _COMPARED)) + 1 if len(a) else np.zeros(0, np.int64)
    for low, high in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=False):
        sides = []
        for rows in (a[low:high], b[low:high]):
            n = size[rows]
            at = np.arange(int(n.sum())) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
            sides.append((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | value[at])
        met = np.sort(np.concatenate(sides))
        met = met[1:][met[1:] == met[:-1]]
        both = np.bincount((met >> np.uint64(32)).astype(np.int64), minlength=len(a[low:high]))
        out[low:high] = both >= least * (size[a[low:high]] + size[b[low:high]] - both)
    return out


def linked(least: float):
    """Joins the sets of each group, of many at once, that have a Jaccard of ``least`` or more."""

    def link(number: np.ndarray, shingles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(np.flatnonzero(number[1:] != number[:-1]) + 1, len(number))
        weight = np.frombuffer(shingles.buffers()[1], np.int32)[shingles.offset + ends].astype(np.int64) >> 2
        last = np.concatenate((np.diff(weight // _COMPARED) > 0, [True]))  # groups after which rows are compared
        us, vs, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for end in ends[last].tolist():
            part = shingles.slice(begin, end - begin)
            row, value = _sets(part)
            size = np.bincount(row, minlength=len(part))
            a, b, dense = _pairs(number[begin:end] - number[begin], row, value, size, least)
            like = _alike(a, b, value, size, least)
            joined = [(a[like], b[like])]
            for rows in dense:
                edges = list(_linked(least)([part.take(pa.array(rows))]).edges())
                joined.append(tuple(rows[list(side)] for side in zip(*edges, strict=True)) if edges else (rows[:0], rows[:0]))
            u, v = trees(len(part), *(np.concatenate(side) for side in zip(*joined, strict=True)))
            us.append(u + begin)
            vs.append(v + begin)
            begin = end
        return np.concatenate(us), np.concatenate(vs)

    return link


def class_links(classes: DataFrame, least: float, most: int = GROUP) -> DataFrame:
    """Edges between ``uid`` of classes that share a ``key`` and have a Jaccard of ``least`` or more.

    In a task, pairs are found by the rarest shingles of a key's classes (``_pairs``), so a common phrase is no work by the square of its classes.
    Classes of a key that is too large for a task, of more than ``most`` bytes, are dealt to tasks by the same rule: once for each of the
    first of their shingles, rarest of the key first, of which two alike share one: no pair is lost. Where that is more work, as among copies,
    they stay one group, of which all pairs of tiles meet.
    """
    common = written(heavy(classes, ["key"], "shingles", most).withColumnRenamed("_n", "n"), "common-keys")
    plain = classes.join(F.broadcast(common), "key", "left_anti").withColumn("token", F.lit(0).cast("long"))
    large = written(classes.join(F.broadcast(common.select("key")), "key"), "common")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, value = _sets(b.column(2)) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            size, at = np.bincount(row, minlength=b.num_rows), pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(value.view(np.int64)), pa.array(_needed(size, least)[row])], names=["key", "uid", "token", "need"])

    cut = large.select("key", "uid", "shingles").mapInArrow(tokens, "key long, uid long, token long, need long")
    met = cut.join(cut.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["key", "token"])
    sets = met.groupBy("key", "uid").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))
    first = sets.filter(F.size("met") >= F.col("need")).select("key", "uid", F.explode(F.slice("met", F.lit(1), (F.size("met") - F.col("need") + 1).cast("int"))).alias("x"))
    first = written(first.select("key", "uid", F.col("x.token").alias("token")), "first")
    cost = first.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum(F.pow("n", F.lit(2))).alias("cost"))
    worse = written(common.join(cost, "key").filter(F.col("cost") >= F.pow("n", F.lit(2))).select("key"), "worse")  # mostly copies, which share all
    parts = first.join(F.broadcast(worse), "key", "left_anti").join(large, ["key", "uid"]).select("key", "uid", "shingles", "token")
    whole = large.join(F.broadcast(worse), "key", "left_semi").withColumn("token", F.lit(0).cast("long"))
    out = written(links_of_many_groups(plain.unionByName(parts).unionByName(whole), ["key", "token"], "uid", "shingles", linked(least), most), "links")
    for done in (common, large, first, worse):
        discard(done)
    return out


def repeated_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """The band keys that occur more than once, written. Keys are shuffled packed, by their last bits: a row for each task's share of a part, not for each key."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.int64), *held])
        order = np.argsort((keys & (PARTS - 1)).astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(keys & (PARTS - 1), minlength=PARTS))
        rows = pa.Array.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer((np.append(0, ends) * 8).astype(np.int32)), pa.py_buffer(keys[order])])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), rows], names=["part", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for _, texts in laid(byte_values(b.column(0))):
                held += [u["keys"].ravel() for u in units(texts)[1:]]
                n += sum(map(len, held[-2:]))
                if n >= _COMPARED:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["part"]):
            keys = np.sort(np.frombuffer(b"".join(byte_values(part.column(1))), np.int64))
            again = keys[1:][keys[1:] == keys[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(again[np.diff(again, prepend=again[:1] - 1) != 0] if len(again) else again)], names=["key"])

    rows = docs.select(utf8(text_col).alias("bytes")).mapInArrow(run, "part int, keys binary")
    return written(rows.repartition("part").sortWithinPartitions("part").mapInArrow(repeated, "key long"), "keys")


def bitmap_of(keys: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bit for the last ``slots`` bits of each key. Tasks set the bits; each part, of 2**16 bits, comes as 8 kB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slot = np.sort(b.column(0).to_numpy())
            cuts = np.flatnonzero(np.diff(slot >> 16)) + 1
            for of in np.split(slot, cuts) if len(slot) else []:
                bits = held.setdefault(int(of[0] >> 16), np.zeros(1 << 13, np.uint8))
                np.bitwise_or.at(bits, (of & 0xFFFF) >> 3, (1 << (of & 7)).astype(np.uint8))
        for part, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([bits.tobytes()])], names=["part", "bits"])

    slot = keys.select(F.col("key").bitwiseAND((1 << slots) - 1).alias("slot"))
    parts = slot.repartition(F.shiftright("slot", 16)).mapInArrow(run, "part long, bits binary")
    bitmap = np.zeros(1 << slots >> 3, np.uint8)
    for row in parts.toLocalIterator():  # at most 2**14 parts
        bitmap[row.part << 13 : row.part + 1 << 13] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def candidates(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bitmap_keys: int = BITMAP_KEYS) -> DataFrame:
    """Units with one of ``keys``: id, words ``first`` to ``last``, bounds, class ``uid``, ``keys``, ``shingles``. Written."""
    n_keys = keys.count()
    few, slots_of = n_keys <= bitmap_keys, min(MOST_SLOTS, max(SLOTS, (8 * n_keys - 1).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys, slots_of) if few else None)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, row long, first long, last long, by_left boolean, by_right boolean, uid long, keys array<long>, shingles binary"
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            before = np.zeros(b.num_rows, np.int64)  # words of a text in blocks that came before
            for rows, texts in laid(byte_values(b.column(2))):
                row = np.array(rows)
                counted, *found = units(texts)
                same = np.concatenate(([False], row[1:] == row[:-1]))
                done = np.cumsum(counted["base"]) - counted["base"]
                lead = before[row] + np.where(same, done - done[np.maximum.accumulate(np.where(same, 0, np.arange(len(row))))], 0)
                np.add.at(before, row, counted["base"])
                for u in found:
                    slots = u["keys"] & ((1 << slots_of) - 1)
                    hit = np.flatnonzero(((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).any(axis=0)) if bits is not None else np.arange(len(u["uid"]))
                    at = u["text"][hit]
                    n = u["count"][hit]
                    ends = np.concatenate(([0], np.cumsum(n)))
                    shingles = u["shingles"][np.arange(int(ends[-1])) + np.repeat(u["offsets"][hit] - ends[:-1], n)]
                    packed = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(shingles)])
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * len(u["keys"]), pa.int32()), pa.array(u["keys"].T[hit].ravel()))
                    columns = [u["first"][hit] + lead[at], u["last"][hit] + lead[at], u["left"][hit], u["right"][hit], u["uid"][hit]]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[at])), b.column(1).take(pa.array(row[at])), *map(pa.array, columns, types), bands, packed], names=["doc", "row", "first", "last", "by_left", "by_right", "uid", "keys", "shingles"])

    row = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))  # rows without an id are told apart
    found = docs.select(F.col(id_col), row.alias("row"), utf8(text_col).alias("bytes")).mapInArrow(run, schema)
    if few:
        return written(found, "units")
    found = written(found.withColumn("unit", F.xxhash64("doc", "row", "first", "last", "uid")), "units")
    wanted = found.select("unit", F.explode("keys").alias("key")).join(keys, "key", "left_semi").select("unit").distinct()
    return written(found.join(wanted, "unit", "left_semi").drop("unit"), "units")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD, least: int = LEAST) -> DataFrame:
    """Repeated spans: id, ``start_word``, ``end_word``, ``n_words``, ``component_id`` (smallest id it occurs in), ``remove``."""
    keys = repeated_keys(docs, text_col)
    found = candidates(docs, keys, id_col, text_col)
    discard(keys)
    pairs = found.select("uid", F.explode("keys").alias("key")).distinct()
    many_classes = pairs.groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).filter("low <> high").select("key")
    met = written(pairs.join(many_classes, "key", "left_semi").select("key", "uid"), "met")
    shapes = found.select("uid", "shingles").join(met.select("uid").distinct(), "uid", "left_semi").dropDuplicates(["uid"])
    classes = written(met.join(shapes, "uid").select("key", "uid", "shingles"), "classes")
    links = class_links(classes, jaccard)
    discard(met)
    discard(classes)
    joined = components(links)
    discard(links)
    rows = found.drop("keys", "shingles").join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    rows = written(rows, "labelled")
    discard(found)
    discard(joined)
    own = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")  # rows without an id come last, each a document
    place = F.struct(own.alias("own"), "first")
    many = rows.groupBy("label").agg(F.min(own).alias("least"), F.max(own).alias("other"), F.min(place).alias("kept"), F.min("doc").alias("component_id"))
    many = written(many.filter("least <> other").select("label", "component_id", "kept"), "repeated")
    dup = rows.join(many, "label").withColumn("remove", place != F.col("kept")).dropDuplicates(["doc", "row", "first", "last"])
    order = Window.partitionBy("doc", "row").orderBy("first", "last")
    far = F.col("first") - F.col("kept.first")  # how far from its first occurrence
    dup = dup.withColumn("end", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap", F.col("first") - F.col("end"))
    alike = (F.col("kept.own") == F.lag("kept.own").over(order)) & (F.abs(far - F.lag(far).over(order)) <= LEAST_UNIT)
    bridged = F.coalesce((F.col("gap") >= LEAST_UNIT) & (F.col("gap") <= BRIDGE) & alike, F.lit(False))
    dup = dup.withColumn("bridged", bridged).withColumn("new", F.coalesce(((F.col("gap") >= LEAST_UNIT) & ~bridged).cast("int"), F.lit(1)))
    dup = dup.withColumn("run", F.sum("new").over(order)).withColumn("own", F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce("end", "first"))))
    spans = dup.groupBy("doc", "row", "run").agg(F.min("first").alias("start_word"), F.max("last").alias("end_word"), F.min("component_id").alias("component_id"), F.max("remove").alias("remove"), F.min_by("by_left", "first").alias("left"), F.max_by("by_right", "last").alias("right"), F.max(F.col("bridged") & (F.col("new") == 0)).alias("bridged"), F.sum("own").alias("own"))
    spans = spans.filter(~F.col("bridged") | (F.col("own") >= COVERED * (F.col("end_word") - F.col("start_word"))))
    proven = F.col("end_word") - F.col("start_word") + RADIUS * ((~F.col("left")).cast("int") + (~F.col("right")).cast("int"))
    return spans.filter(proven >= least).select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "component_id", "remove")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
