"""Benchmark decontamination with a generalised suffix automaton over words.

The test items are normalised (A-Z to a-z, words of digits, letters and all non-ASCII) and put into one suffix automaton
of word numbers. Every document is streamed through it in blocks; after each word the automaton holds the longest suffix
of the document that is part of some item. A match of ``window`` words or more (or a whole item that is shorter) is hit.

Cases: null and empty texts have no words and no hits; items without words are ignored; an item without an id hits like any
other but isn't named; equal items each count; repeated documents are repeated in the result; an empty documents or
benchmark table gives empty or all-clean results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, table, utf8

WINDOW = 10
#: Documents of which a larger share of the words is hit are removed whole by ``cut``.
COVERAGE = 0.5
#: Words of items that one automaton holds (some 100 MB); more items make more automata, each a pass in the same stage.
SHARD_WORDS = 200_000
BLOCK = 1 << 20
_KEEP = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text of any length, a block at a time; blocks end between words."""
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and _KEEP[text[end]] != 32:
            end += 1
        yield words_of(text[start:end])
        start = end


class Automaton:
    """Generalised suffix automaton of items given as (name, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab) + 1))
            state = 0
            for w in words:
                state = self.next[state][self.vocab[w]]
                path.append((state, len(path) + 1))
            ends.append(path)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: By state, the state of its suffix of ``window`` words; whole shorter items among its suffixes.
        self.top = [0] * len(self.link)
        self.short: list[tuple] = [()] * len(self.link)
        self.items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for (name, words), path in zip(items, ends, strict=True):
            if words and len(words) < window:
                whole.setdefault(path[-1][0], []).append((len(words), name))
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.top[s] = s if self.length[up] < window else self.top[up]
            self.short[s] = self.short[up] + tuple(whole.get(s, ()))
        for (name, _), path in zip(items, ends, strict=True):
            for s, n in path:
                if n >= window:
                    self.items.setdefault(self.top[s], set()).add(name)
        self.least = min([window, *(len(w) for _, w in items if w)])

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, c)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str], int]:
        """Number of words, hit word ranges (merged), items found, and the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        total = longest = state = length = 0
        step, link, lengths, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        for words in word_blocks(text):
            ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
            breaks = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
            runs = np.diff(breaks) - 1
            for r in np.flatnonzero((runs >= self.least) | (np.arange(len(runs)) == 0) | (np.arange(len(runs)) == len(runs) - 1)):
                begin, end = int(breaks[r]) + 1, int(breaks[r + 1])
                if begin:
                    state = length = 0
                for i, c in enumerate(ids[begin:end].tolist(), total + begin):
                    while state and c not in step[state]:
                        state = link[state]
                        length = lengths[state]
                    if c in step[state]:
                        state = step[state][c]
                        length += 1
                        longest = max(longest, length)
                        if length >= window:
                            spans.append((i + 1 - length, i + 1))
                            if top[state] not in seen:
                                seen.add(top[state])
                                found |= self.items[top[state]]
                        for n, name in short[state]:
                            if n <= length:
                                spans.append((i + 1 - n, i + 1))
                                found.add(name)
                if end < len(ids):
                    state = length = 0
            total += len(words)
        return total, merged(spans), found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """Automata of at most ``SHARD_WORDS`` words each (one item may exceed it), one after another: the driver holds one shard."""
    sized = items.select(F.col(id_col).cast("string").alias("item"), utf8(text_col).alias("bytes"))
    total = sized.agg(F.sum(F.length("bytes"))).first()[0] or 0
    n = max(1, -(-total // (4 * SHARD_WORDS)))
    for k in range(n):
        rows = sized.filter(F.pmod(F.xxhash64("item", "bytes"), F.lit(n)) == k).orderBy("item", "bytes").collect()
        yield Automaton([(r.item, w) for r in rows if (w := words_of(bytes(r.bytes)))], window)


def match(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: its id, ``n_words``, ``n_hit``, ``spans`` (word ranges), ``items`` (sorted), ``longest``."""
    spark = docs.sparkSession
    out = docs.select(F.col(id_col), utf8(text_col).alias("bytes"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for automaton in shards(items, item_id, item_text, window):
        held = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            a = held.value
            for b in batches:
                n_words, spans, names, longest = [], [], [], []
                for text, old_s, old_i, old_l in zip(byte_values(b.column(1)), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(3).to_pylist(), strict=True):
                    n, s, f, m = a.scan(text)
                    n_words.append(n)
                    spans.append([list(x) for x in merged([*map(tuple, old_s), *s])] if s or old_s else [])
                    names.append(sorted({*old_i, *f} - {None}))
                    longest.append(max(m, old_l))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))], names=b.schema.names)

        out = out.mapInArrow(scan, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), "spans", "items", "longest")


def cut_text(text: bytes, automata: list[Automaton], limit: float = COVERAGE) -> bytes | None:
    """The text without its hit words and what stands between them, until nothing is hit; None beyond the coverage limit."""
    n, spans = 0, []
    for a in automata:
        n, s, _, _ = a.scan(text)
        spans += s
    if not spans:
        return text
    if sum(b - a for a, b in merged(spans)) > limit * n:
        return None
    while spans:
        at = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_KEEP))]
        kept, last = [], 0
        for a, b in merged(spans):
            kept.append(text[last : at[a][0]].rstrip(b" "))
            last = at[b - 1][1]
        kept.append(text[last:])
        text = b"".join(kept)
        spans = [s for a in automata for s in a.scan(text)[1]]
    return text


def cut(docs: DataFrame, items: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: float = COVERAGE) -> DataFrame:
    """``docs`` with hit spans cut out of the text; documents hit over ``limit`` are gone. All other columns stay as they are, null texts too."""
    held = docs.sparkSession.sparkContext.broadcast(list(shards(items, item_id, item_text, window)))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if x is None else cut_text(x.encode(), held.value, limit) for x in (v.as_py() for v in b.column(at))]
            keep = pa.array([t is not None or not b.column(at)[i].is_valid for i, t in enumerate(texts)])
            new = pa.array([None if t is None else t.decode() for t in texts], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new).filter(keep)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(ws)) AS n FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, p, n FROM dw WHERE EXISTS (SELECT 1 FROM iw WHERE iw.n = dw.n AND iw.win = dw.win)),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT dw.doc_id, CAST(iw.item_id AS VARCHAR) AS item FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

