"""Alignment of two tokenizers over the same texts, by the byte offsets where tokens of both end.

A text is encoded by a byte-level vocabulary (A, with a space before it) and a piece vocabulary (B, which puts that space
there itself). Cumulative ends of each side are keys of a dictionary of token indices; the sorted common keys cut both id
lists into groups, and each group's links are all its A-B pairs (``common_ends``, ``Aligner.learn``).

Neither vocabulary has a token over the border between a character that is not white space and a space behind it: A's
pattern never joins them, and none of B's pieces has a space behind another character (checked when a worker starts; if
one had, texts are encoded whole). So such a border is a common end, and a text is a row of units, each aligned once and kept in a
bounded memory of the worker. A text of which some unit's bytes are not given back by both sides is encoded whole.

1. Documents become rows of counts, the digest of the groups, and their distinct pairs with multiplicities. Written.
2. Pairs are counted by document: in each batch, in each task, then in a shuffle. The highest count of an A id is joined
   back; there are no more A ids than the vocabulary has.
3. Pairs that hold at least 1/65,536 of all (document, pair) rows, of which there can't be more than 65,536, are broadcast
   and summed where the documents' rows are read. Every other pair meets its count in a shuffle, in which none can be hot.

Cases: null and empty texts, and texts whose joined bytes differ on a side, have zeros and an empty digest; repeated rows
are documents of their own and each count; an empty table gives no rows; a row without an id keeps null. A worker's memory grows with
the longest run of characters without a space, since neither library encodes part of it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import byte_values, discard, table, utf8, written

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A pair is one long: the A id, then 32 bits for the B id.
B_BITS = 32
#: At most so many pairs can hold 1/HOT of all rows of (document, pair) each.
HOT = 65_536
#: Bytes that a worker's memory of units may take, and what one takes beside its own and its groups' bytes.
MEMORY, EACH = 45_000_000, 420
#: Bytes of pairs that a worker counts or looks up at once.
PORTION = 1 << 22
#: Units that go to the libraries as one text.
AT_ONCE = 4000
#: Share of the memory's units, those used most, that is kept when it is full.
REST = 0.4
_GAP = re.compile(r"\s ")
_BORDER = re.compile(r"(?<=\S) (?!\Z)")


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Behind how many tokens of each side are the places where tokens of both end, in order."""
    of_a, of_b = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))  # noqa: B905
    ends = sorted(of_a.keys() & of_b.keys())
    return np.array([of_a[e] for e in ends], np.int64), np.array([of_b[e] for e in ends], np.int64)


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one run behind the other."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(begins - first, sizes) + np.arange(int(sizes.sum()))


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Units of text under both vocabularies, with a memory of those already aligned."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = _byte_alphabet()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        entries = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, side)], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{mark}".encode() for i in range(max(len(self.a_bytes), len(entries))) for mark in ",|;"]
        self.cut = not any("▁" in p.lstrip("▁") for p in entries)
        self.last = 0
        self.forget()

    def forget(self, rest: float = 0.0) -> None:
        """Start the memory anew, with the share ``rest`` of its units that was used most."""
        kept = np.sort(np.argsort(-np.frombuffer(self.uses, np.int64), kind="stable")[: int(rest * len(self.laid))]).tolist() if rest else []
        units = list(self.known) if rest else []
        old = (self.counts, self.laid, self.links) if rest else ((), [], [])
        self.known: dict[str, int] = {}  # unit to its place, in the order of places
        self.size = 0
        self.uses = array("q")
        self.counts = tuple(array("q") for _ in range(3))  # of each unit: A ids, B ids, groups
        self.laid: list[bytes | None] = []  # its groups as text, a mark behind each; None: a side doesn't give its bytes back
        self.links: list[bytes] = []  # its A-B pairs, a long each
        if kept:
            counts = [np.frombuffer(column, np.int64)[kept] for column in old[0]]
            self._add([units[k] for k in kept], [old[1][k] for k in kept], [old[2][k] for k in kept], *counts)

    def encoded(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units whose bytes both sides give back: they, numbers of their A and B ids, and the ids one behind the other. The others are marked in the memory."""
        a_side = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        b_side = self.b.encode(units, num_threads=1)
        good = [b"".join([self.a_bytes[i] for i in x]) == f" {u}".encode() == b"".join([self.b_bytes[i] for i in y]) for u, x, y in zip(units, a_side, b_side, strict=True)]
        bad = [u for u, fine in zip(units, good, strict=True) if not fine]
        self._add(bad, [None] * len(bad), [b""] * len(bad), *(np.zeros(len(bad), np.int64),) * 3)
        units, a_side, b_side = ([x for x, fine in zip(side, good, strict=True) if fine] for side in (units, a_side, b_side))
        return (units, *(np.array([*map(len, side)], np.int64) for side in (a_side, b_side)), *(np.array([*chain.from_iterable(side)], np.int64) for side in (a_side, b_side)))

    def encoded_as_one(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The same for units without white space at their ends, as one text in a call of each library: their ends are ends of tokens. None if it can't be so."""
        text = " ".join(units)
        raw = f" {text}".encode()
        a, b = np.array(self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text), np.int64)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in b.tolist()]) != raw:
            return None
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        found = []
        for stops in (np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])):
            n = np.searchsorted(stops, ends, side="right")
            if (stops[n - 1] != ends).any():
                return None
            found.append(np.diff(n, prepend=0))
        return units, *found, a, b

    def learn(self, units: list[str]) -> None:
        """Encode and align units that aren't known, many at once: their ends are common ends."""
        plain = [u for u in units if self.cut and u and not (u[0].isspace() or u[-1].isspace())]
        odd = list(set(units).difference(plain)) if len(plain) < len(units) else []
        for part in [plain[k : k + AT_ONCE] for k in range(0, len(plain), AT_ONCE)]:
            self.align(*(self.encoded_as_one(part) or self.encoded(part)))
        if odd:
            self.align(*self.encoded(odd))

    def align(self, units: list[str], n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Groups and links of encoded units, into the memory."""
        if not units:
            return
        to_a, to_b = common_ends(np.cumsum(self.a_sizes[a]).tolist(), np.cumsum(self.b_sizes[b]).tolist())
        xs, ys = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)  # tokens of each group
        # every token with the mark behind it: ids of a group's A side, then of its B side
        token = np.empty(len(a) + len(b), np.int64)
        shown_a, shown_b = np.arange(len(a)) + np.repeat(to_b - ys, xs), np.arange(len(b)) + np.repeat(to_a, ys)
        token[shown_a], token[shown_b] = a * 3, b * 3
        token[shown_a[to_a - 1]] += 1
        token[shown_b[to_b - 1]] += 2
        # links: each A token with all of its group's B tokens
        wide = np.repeat(ys, xs)
        links = (np.repeat(a << B_BITS, wide) | b[spread(np.repeat(to_b - ys, xs), wide)]).tobytes()
        marked = [self.written[k] for k in token.tolist()]
        stops, ends = np.cumsum(n_a + n_b).tolist(), (8 * np.cumsum(wide)[np.cumsum(n_a) - 1]).tolist()
        groups = np.diff(np.searchsorted(to_a, np.cumsum(n_a), side="right"), prepend=0)
        cut = lambda whole, at: [whole[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]
        self._add(units, [b"".join(x) for x in cut(marked, stops)], cut(links, ends), n_a, n_b, groups)

    def _add(self, units: list[str], laid: list[bytes | None], links: list[bytes], *counts: np.ndarray) -> None:
        self.known.update(zip(units, range(len(self.laid), len(self.laid) + len(units)), strict=True))
        self.laid += laid
        self.links += links
        for column, n in zip(self.counts, counts, strict=True):
            column.frombytes(n.astype(np.int64).tobytes())
        self.uses.frombytes(bytes(8 * len(units)))
        self.size += EACH * len(units) + 4 * sum(map(len, units)) + sum(map(len, filter(None, laid))) + sum(map(len, links))

    def units(self, text: str) -> list[str]:
        """A text cut at each space behind a character that isn't white space. The space that begins a unit is not shown."""
        if not self.cut:
            return [text]
        if text[0] == " " or text[-1] == " " or _GAP.search(text):
            return _BORDER.split(text)
        return text.split(" ")

    def __call__(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Of each text: numbers of A ids, B ids, groups and links; the digest; distinct pairs and how often each is linked."""
        if self.size > MEMORY:
            self.forget(REST if self.size - self.last < MEMORY else 0.0)
        cut = [self.units(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        before = self.size
        if new:
            self.learn(list(new))
        self.last = self.size - before  # what the last texts took
        for text, units in zip(texts, cut, strict=True):
            at = [self.known[u] for u in units]
            laid = [self.laid[k] for k in at]
            if None in laid:
                laid, at = self._whole(text, len(units) > 1)
            if not laid:
                yield [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            links = np.frombuffer(b"".join([self.links[k] for k in at]), np.int64)
            pairs, times = np.unique(links, return_counts=True)
            place = np.array(at)
            np.add.at(np.frombuffer(self.uses, np.int64), place, 1)
            counts = [int(np.frombuffer(column, np.int64)[place].sum()) for column in self.counts]
            yield [*counts, len(links)], hashlib.sha256(b"".join(laid)[:-1]).hexdigest(), pairs, times

    def _whole(self, text: str, again: bool) -> tuple[list[bytes], list[int]]:
        """A text as one unit, if both sides give its bytes back; else nothing."""
        if again and text not in self.known:
            self.learn([text])
        k = self.known.get(text)
        return ([self.laid[k]], [k]) if k is not None and self.laid[k] is not None else ([], [])


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One aligner, with its memory, for each worker."""
    return Aligner(byte_level, pieces)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per document: ``row``, id, counts, digest, and its distinct pairs with multiplicities, as little-endian longs. Not written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_level, pieces)
        for b in batches:
            for rows, texts in _portions(b.column(2)):
                found = list(align(texts))
                counts = np.array([x[0] for x in found], np.int64).reshape(-1, 4)
                columns = [*map(pa.array, counts.T), pa.array([x[1] for x in found], pa.string()), *(pa.array([x[k].astype("<i8").tobytes() for x in found], pa.binary()) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(rows)), b.column(1).slice(rows.start, len(rows)), *columns], names=["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = f"row long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), utf8(text_col).alias("bytes")).mapInArrow(run, schema)


def _portions(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[range, list[str]]]:
    """Texts and their places, some ``size`` bytes at a time."""
    held, total, begin = [], 0, 0
    for k, raw in enumerate(byte_values(texts)):
        held.append(raw.decode())
        total += len(raw)
        if total >= size:
            yield range(begin, k + 1), held
            held, total, begin = [], 0, k + 1
    if held:
        yield range(begin, begin + len(held)), held


def pair_portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``aligned`` whose pairs, in a column, take some ``PORTION`` bytes. The worker aligns no more, so its aligner goes first."""
    aligner.cache_clear()
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // PORTION)) + 1).tolist(), b.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(begin, end - begin)


def pair_counts(found: DataFrame) -> DataFrame:
    """(``pair``, ``n``, ``best``): in how many documents a pair is linked, and whether no pair of its A id has more. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pair_portions(batches, 0):
            joined = b"".join(byte_values(b.column(0)))
            pairs, n = np.unique(np.frombuffer(joined, "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = written(found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    a = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most: bounded by the vocabulary
    graded = written(counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "graded")
    discard(counts)
    return graded


def totals(found: DataFrame) -> DataFrame:
    """(``row``, ``n_best``, ``count_sum``) of every row of ``aligned`` that has links."""
    graded = pair_counts(found)
    every = graded.agg(F.sum("n")).first()[0] or 0
    hot = graded.filter(F.col("n") * HOT >= every).collect()  # at most HOT rows: each holds 1/HOT of the sum
    hot = sorted((r.pair, r.n, r.best) for r in hot)
    held = found.sparkSession.sparkContext.broadcast(tuple(np.array([h[k] for h in hot], np.int64) for k in range(3)))

    def split(batches: Iterator[pa.RecordBatch], cold: bool) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for b in pair_portions(batches, 1):
            raw = list(byte_values(b.column(1)))
            pairs = np.frombuffer(b"".join(raw), "<i8")
            times = np.frombuffer(b"".join(byte_values(b.column(2))), "<i8")
            rows = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])
            at = np.searchsorted(known, pairs)
            at[at == len(known)] = 0
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            if cold:
                columns = [rows[~hit], pairs[~hit], times[~hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "pair", "times"])
                continue
            own, place = np.unique(rows[hit], return_inverse=True)
            sums = [np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)]
            np.add.at(sums[0], place, times[hit] * best[at[hit]])
            np.add.at(sums[1], place, times[hit] * n[at[hit]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own, *sums)], names=["row", "n_best", "count_sum"])

    read = found.select("row", "pairs", "times")
    warm = read.mapInArrow(lambda batches: split(batches, False), "row long, n_best long, count_sum long")
    cold = read.mapInArrow(lambda batches: split(batches, True), "row long, pair long, times long").join(graded, "pair")
    cold = cold.select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return warm.unionByName(cold).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    found = written(aligned(docs, id_col, text_col, byte_level, pieces), "aligned")
    out = found.drop("pairs", "times").join(totals(found), "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents", "doc_id", "text"))
