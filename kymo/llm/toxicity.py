"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nyström landmarks.

A text is a bag of words: lower case, letters only, so that marks inside a word ("i.d.i.o.t") don't hide it, and runs of
single letters are one word. The kernel of two words sums over all subsequences of up to ``ORDER`` letters, each weighted
by DECAY to the power of the stretch it spans, so gaps and inserted letters cost little; it is normalised and raised to
SHARPEN, which is a kernel again. A text has, for each landmark, the largest of its words' kernels and the log of their sum.

Landmarks are the words that speak most for either label by the G statistic. The Nyström map is K(x, L) K(L, L)^(-1/2); a
linear SVM on it is fitted by dual coordinate descent to labelled texts, and its margin is calibrated to a probability by
a logistic fit on margins of texts it wasn't fitted on. The fit is on at most ``SAMPLE`` labelled rows of each label whose
text has at most ``SAMPLE_CHARS`` bytes, chosen by hash; every whole text is then scored by the tasks that read it.

Cases: null and empty texts have no words and get the score of an empty bag; without labelled rows of both labels all
scores are 0; texts of any length are scored in blocks; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, table, texts_of, utf8

ORDER, DECAY, SHARPEN = 4, 0.9, 4
LANDMARKS, APART = 64, 0.85
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Kernel values under this are taken as none, and so are those of words that have fewer than COVER of a landmark's letters in
#: its order, whatever stands between them.
LEAST, COVER = 0.001, 0.6
#: Words longer than this are read in windows of this length that overlap by half.
LONGEST = 32
MEMORY = 600_000
#: Words of like length are read together.
_LENGTHS = ((-1, 7), (7, 10), (10, 13), (13, 18), (18, LONGEST))
_BLOCK = 1 << 20
_DROP = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122 or c in b" \t\n\x0b\x0c\r"))
_SINGLES = re.compile(rb"(?<![^\s])(?:[a-z]\s){2,}[a-z](?![^\s])")


def words(text: bytes) -> list[bytes]:
    """The words of a text of any length."""
    out: list[bytes] = []
    start = 0
    while start < len(text):
        end = min(len(text), start + _BLOCK)
        while end < len(text) and text[end] not in b" \n\t\r":
            end += 1
        plain = text[start:end].decode(errors="replace").lower().encode().translate(None, _DROP)
        out += plain.split()
        out += [b"".join(m[0].split()) for m in _SINGLES.finditer(plain)]
        start = end
    return out


def _codes(strings: list[bytes]) -> np.ndarray:
    """Strings with marks at their ends, one a row, zero-padded."""
    width = max(map(len, strings)) + 2
    flat = b"".join((b"<" + s + b">").ljust(width, b"\0") for s in strings)
    return np.frombuffer(flat, np.uint8).reshape(len(strings), width)


@cache
def _reach(width: int) -> np.ndarray:
    """What a match at one place gives to every later place: DECAY to the power of the stretch."""
    place = np.arange(width)
    gap = place[None, :] - place[:, None]
    return np.where(gap >= 0, DECAY ** (np.maximum(gap, 0) + 2.0), 0).astype(np.float32)


def raw_kernel(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of every row with one string, summed over the orders 1 to ORDER."""
    n, width = rows.shape
    m = len(other)
    reach = _reach(width)
    same = [(rows == c) for c in other]
    inner = np.ones((m + 1, n, width + 1), np.float32)
    total = np.zeros(n, np.float32)
    for order in range(ORDER):
        gained = np.zeros(n, np.float32)
        following = np.zeros((m + 1, n, width + 1), np.float32)
        for j in range(m):
            hit = same[j] * inner[j, :, :-1]
            gained += hit.sum(axis=1)
            if order < ORDER - 1:
                following[j + 1, :, 1:] = DECAY * following[j, :, 1:] + hit @ reach
        total += gained * np.float32(DECAY**2)
        inner = following
    return total


def self_kernel(strings: list[bytes], some: int = 500) -> np.ndarray:
    """The kernel of each string with itself, ``some`` at once (as many as stay in a core's cache)."""
    return np.concatenate([_own(_codes(strings[k : k + some])) for k in range(0, len(strings), some)])


def _own(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    reach = _reach(width)
    inner = np.ones((width + 1, n, width + 1), np.float32)
    total = np.zeros(n, np.float32)
    for order in range(ORDER):
        following = np.zeros_like(inner)
        gained = np.zeros(n, np.float32)
        for j in range(width):
            hit = ((rows == rows[:, j : j + 1]) & (rows[:, j : j + 1] > 0)) * inner[j, :, :-1]
            gained += hit.sum(axis=1)
            if order < ORDER - 1:
                following[j + 1, :, 1:] = DECAY * following[j, :, 1:] + hit @ reach
        total += gained * np.float32(DECAY**2)
        inner = following
    return total


def _letters(strings: list[bytes]) -> np.ndarray:
    """A set of 64 bits of the bytes of each string."""
    codes = _codes(strings)[:, 1:]
    bit = np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63))
    width = np.array(list(map(len, strings)))
    return np.bitwise_or.reduce(np.where(np.arange(codes.shape[1])[None, :] < width[:, None], bit, np.uint64(0)), axis=1)


def in_order(rows: np.ndarray, other: bytes) -> np.ndarray:
    """The length of the longest common subsequence of each row's string with ``other`` (of at most 63 bytes): one bit for each of its bytes."""
    places = np.zeros(256, np.uint64)
    for k, c in enumerate(other):
        places[c] |= np.uint64(1 << k)
    free = np.full(len(rows), (1 << len(other)) - 1, np.uint64)
    for j in range(rows.shape[1]):
        hit = free & places[rows[:, j]]
        free = (free + hit) | (free - hit)
    return len(other) - np.bitwise_count(free & np.uint64((1 << len(other)) - 1)).astype(np.int64)


class Kernel:
    """The normalised, sharpened kernel with a fixed list of landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.codes = [np.frombuffer(b"<" + s + b">", np.uint8) for s in landmarks]
        self.own = self_kernel(landmarks)
        self.letters = _letters(landmarks)
        self.known: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = [np.zeros(len(landmarks), np.float32)]

    def values(self, strings: list[bytes]) -> np.ndarray:
        """A row for each string (of at most LONGEST bytes), a column for each landmark."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        if not strings:
            return out
        lengths = np.array(list(map(len, strings)))
        near = np.bitwise_count(_letters(strings)[:, None] & self.letters[None, :]) >= COVER * np.bitwise_count(self.letters)[None, :]
        any_near = near.any(axis=1)
        for low, high in _LENGTHS:
            some = np.flatnonzero(any_near & (lengths > low) & (lengths <= high))
            if not len(some):
                continue
            part = [strings[i] for i in some]
            codes = _codes(part)
            own = np.zeros(len(part), np.float32)  # of those that some landmark needs
            for j, other in enumerate(self.codes):
                rows = np.flatnonzero(near[some, j])
                rows = rows[in_order(codes[rows], self.landmarks[j]) >= COVER * len(self.landmarks[j])]
                if len(rows):
                    missing = rows[own[rows] == 0]
                    if len(missing):
                        own[missing] = self_kernel([part[i] for i in missing])
                    raw = np.concatenate([raw_kernel(codes[rows[k : k + 2000]], other) for k in range(0, len(rows), 2000)])
                    out[some[rows], j] = raw / np.sqrt(own[rows] * self.own[j])
        out = out**SHARPEN
        out[out < LEAST] = 0
        return out

    def forget(self) -> None:
        self.known.clear()
        del self.rows[1:]

    def learn(self, new: set[bytes]) -> None:
        strings = list(new)
        pieces = [(k, s[a : a + LONGEST]) for k, s in enumerate(strings) for a in range(0, max(1, len(s) - LONGEST // 2), LONGEST // 2)]
        values = self.values([s for _, s in pieces])
        at = [0] * len(strings)
        for row in np.flatnonzero(values.any(axis=1)).tolist():
            k = pieces[row][0]
            if at[k]:
                np.maximum(self.rows[at[k]], values[row], out=self.rows[at[k]])
            else:
                at[k] = len(self.rows)
                self.rows.append(values[row].copy())
        self.known.update(zip(strings, at, strict=True))

    def bags(self, texts: list[list[bytes]]) -> np.ndarray:
        """For each bag of words the largest of its words' kernel values with each landmark, and the logarithm of one more than their sum."""
        m = len(self.landmarks)
        every = set().union(*texts)
        new = every.difference(self.known)
        if len(self.known) + len(new) > MEMORY:  # start anew with the words of these texts
            self.forget()
            new = every
        self.learn(new)
        out = np.zeros((len(texts), 2 * m), np.float32)
        for k, bag in enumerate(texts):
            hits = [r for r in map(self.known.__getitem__, bag) if r]
            if hits:
                rows = np.stack([self.rows[r] for r in hits])
                out[k, :m] = rows.max(axis=0)
                out[k, m:] = np.log1p(rows.sum(axis=0))
        return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Linear SVM by dual coordinate descent (hinge loss, labels of equal total weight); the last column of x is the bias."""
    rng = np.random.default_rng(0)
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    a, w = np.zeros(len(y)), np.zeros(x.shape[1])
    norm = (x * x).sum(axis=1)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), cost[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels (1, -1) to margins, by Newton's method."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
    return max(float(w[0]), 1e-3), float(w[1])


class Model:
    """Landmarks, SVM weights and calibration; ``fit`` makes one from labelled bags of words."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None = None, slope: float = 1.0, offset: float = 0.0):
        self.kernel, self.weights, self.slope, self.offset = kernel, weights, slope, offset

    @classmethod
    def fit(cls, bags: list[list[bytes]], labels: list[int]) -> Model:
        y = np.where(np.array(labels) == 1, 1, -1)
        if not (y > 0).any() or not (y < 0).any():
            return cls(None)
        kernel = Kernel(landmarks(bags, y))
        values = kernel.bags(bags).astype(float)
        own = kernel.values(kernel.landmarks).astype(float)
        own = (own + own.T) / 2
        power, basis = np.linalg.eigh(own)
        good = power > 1e-4 * power.max()
        nystrom = basis[:, good] / np.sqrt(power[good])
        m = len(own)
        x = np.concatenate([values[:, :m] @ nystrom, values[:, m:] @ nystrom, np.ones((len(y), 1))], axis=1)
        fold = np.arange(len(y)) % 4
        margin = np.zeros(len(y))
        for k in range(4):
            if len(set(y[fold != k])) == 2:
                margin[fold == k] = x[fold == k] @ svm(x[fold != k], y[fold != k])
        w = svm(x, y)
        r = nystrom.shape[1]
        return cls(kernel, np.concatenate([nystrom @ w[:r], nystrom @ w[r : 2 * r], w[-1:]]), *logistic(margin, y))

    def score(self, bags: list[list[bytes]]) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(bags))
        margin = self.kernel.bags(bags) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def landmarks(bags: list[list[bytes]], y: np.ndarray, most: int = LANDMARKS) -> list[bytes]:
    """Words of the largest G statistic between the labels; most speak for the label 1, some against it."""
    counts = {s: Counter(w for bag, label in zip(bags, y, strict=True) if label == s for w in set(bag) if 2 < len(w) <= LONGEST) for s in (1, -1)}
    n = {s: int((y == s).sum()) for s in (1, -1)}
    scored = []
    for w, a in counts[1].items():
        if a < (2 if n[1] < 100 else 3):
            continue
        b = counts[-1][w]
        rate = (a + b) / (n[1] + n[-1])
        if a <= n[1] * rate:
            continue
        g = sum(o * np.log(o / (k * e)) for o, k, e in ((a, n[1], rate), (b, n[-1], rate), (n[1] - a, n[1], 1 - rate), (n[-1] - b, n[-1], 1 - rate)) if o)
        scored.append((-g, w))
    found: list[bytes] = []
    ranked = [w for _, w in sorted(scored)[: 10 * most]]
    if ranked:  # one of several that are much alike is enough
        alike = Kernel(ranked).values(ranked) ** (1 / SHARPEN)
        chosen: list[int] = []
        for k in range(len(ranked)):
            if len(chosen) < most and all(max(alike[k, c], alike[c, k]) < APART for c in chosen):
                chosen.append(k)
        found = [ranked[k] for k in chosen]
    return found or sorted(w for bag in bags for w in bag if 2 < len(w) <= LONGEST)[:1] or [b"none"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the driver; at most ``sample`` rows of each label, the first by the hash of their ids."""
    raw = docs.select(F.col(id_col), utf8(text_col).alias("bytes")).filter(F.length("bytes").between(1, SAMPLE_CHARS))
    known = labels.select(id_col, F.col(label_col).alias("label")).dropna().dropDuplicates([id_col])
    marked = raw.select(id_col, F.xxhash64("bytes").alias("hash")).join(known, id_col).select("hash", "label").distinct()
    chosen = [(r.hash, label) for label in (1, 0) for r in marked.filter(F.col("label") == label).orderBy("hash").limit(sample).collect()]  # hashes alone
    texts = texts_of(raw.select("bytes"), sorted({h for h, _ in chosen}))
    bags, y = [words(texts[h]) for h, _ in chosen], [label for _, label in chosen]
    order = np.random.default_rng(1).permutation(len(y))
    return Model.fit([bags[k] for k in order], [y[k] for k in order])


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    """Scores of a text column, some megabytes at a time."""
    scores, bags, size = [], [], 0
    for text in byte_values(column.cast(pa.binary())):
        bags.append(words(text))
        size += len(text)
        if size > 1 << 22:
            scores.append(model.score(bags))
            bags, size = [], 0
    return np.concatenate([*scores, model.score(bags)])


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of the label 1 as column ``name``, in place of one of that name."""
    if model.kernel:  # what was remembered of the sample isn't sent to the tasks
        model.kernel.forget()
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(b.column(at), held.value), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows of a score of ``least`` or more; nothing else changes."""
    if model.kernel:
        model.kernel.forget()
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), held.value) < least))
        if held.value.kernel:  # later stages run in the same worker
            held.value.kernel.forget()

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.filter(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
