"""Secret scans: exact patterns, and a character convolutional network over every other candidate in its context.

Base findings are the matches of three patterns. A candidate is a run of 16 or more letters, digits and + / _ . = - that
has a digit or capitals among small letters, and of which ``OUTSIDE`` characters or more lie in no base finding. The network
reads all its bytes, in windows of ``BODY`` bytes that overlap by half and of which the last ends where the run ends, with
``CONTEXT`` bytes on either side of the run: byte embeddings, one convolution, the largest and the mean activation, a
logistic output. It is trained in numpy on labelled findings: base matches of a bounded sample of documents are secrets,
the sample's other candidates and ordinary words are not; random keys put into the sample's contexts stand for secrets
without a keyword. The sample's texts are dealt to three parts: on the first the network is fitted, on the second its output
is calibrated by a logistic fit and the threshold set to the highest that keeps ``RECALL`` of that part's secrets, and on the
third ``report`` states recall and precision. Candidates over the threshold are added as kind ``net``; base findings always
stay.

Cases: null and empty texts have no findings; without base findings in the sample, random keys alone are the secrets; without
enough of a sample nothing is added to base findings;
texts of any length are scanned whole; repeated rows get equal findings; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_values, char_starts, table, texts_of, utf8

# The base patterns, with the fewest characters of each kind.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "net")

_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{16,}")
_PLAUSIBLE = re.compile(rb"[0-9]|[a-z][A-Z].*[a-z][A-Z]")
CONTEXT, BODY, WIDTH, DIMS, FILTERS = 16, 48, 5, 12, 24
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_EACH = 4000, 20_000, 1500
RECALL, OUTSIDE = 0.98, 8
_SIZE = CONTEXT * 2 + BODY


def base(text: bytes) -> list[tuple[int, int, str]]:
    """Base findings as (start, end, kind) in bytes, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: bytes, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Plausible runs with ``OUTSIDE`` bytes or more in none of the findings ``taken`` (by start)."""
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if not _PLAUSIBLE.search(m[0]):
            continue
        while k < len(taken) and max(e for _, e, _ in taken[k : k + 3]) <= a:
            k += 1
        free, at, j = 0, a, k
        while j < len(taken) and taken[j][0] < b:
            free += max(0, min(taken[j][0], b) - at)
            at = max(at, taken[j][1])
            j += 1
        if free + max(0, b - at) >= min(OUTSIDE, b - a):
            out.append((a, b))
    return out


def windows(text: bytes, a: int, b: int) -> list[bytes]:
    """All the candidate's bytes with its context, in one or more windows of fixed size; 0 stands for what isn't there."""
    left = text[max(0, a - CONTEXT) : a].rjust(CONTEXT, b"\0")
    right = text[b : b + CONTEXT].ljust(CONTEXT, b"\0")
    starts = [*range(a, b - BODY, BODY // 2), max(a, b - BODY)]
    return [left + text[s : min(b, s + BODY)].ljust(BODY, b"\0") + right for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Byte embedding, convolution, largest and mean activation, logistic output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (256, DIMS)), "k": rng.normal(0, (2 / (WIDTH * DIMS)) ** 0.5, (WIDTH, DIMS, FILTERS)), "b": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.slope, self.offset = 1.0, 0.0
        self.threshold = 0.5
        self.report: dict[str, float] = {}

    def _forward(self, x: np.ndarray) -> tuple:
        lookup = np.einsum("vd,odf->ovf", self.p["e"], self.p["k"])  # what each byte at each offset gives each filter
        n = x.shape[1] - WIDTH + 1
        act = sum(lookup[o][x[:, o : o + n]] for o in range(WIDTH)) + self.p["b"]
        act = np.maximum(act, 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None, :], 1)[:, 0], act.mean(axis=1)], axis=1)
        return pooled @ self.p["w"] + self.p["c"], pooled, top, act

    def output(self, x: list[bytes]) -> np.ndarray:
        out = [self._forward(np.frombuffer(b"".join(x[k : k + 512]), np.uint8).reshape(-1, _SIZE))[0] for k in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, parts: list[list[bytes]]) -> np.ndarray:
        """The calibrated probability of each candidate, of its likeliest window."""
        if not parts:
            return np.zeros(0)
        best = np.maximum.reduceat(self.output([w for part in parts for w in part]), np.cumsum([0, *map(len, parts[:-1])]))
        return _sigmoid(self.slope * best + self.offset)

    def calibrate(self, parts: list[list[bytes]], y: np.ndarray) -> None:
        """Logistic fit of labels to outputs by Newton's method, drawn towards no change; then the highest threshold that keeps RECALL of the secrets."""
        self.slope, self.offset = 1.0, 0.0
        logit = np.log((p := np.clip(self.probability(parts), 1e-9, 1 - 1e-9)) / (1 - p))
        x, w = np.stack([logit, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
        target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        for _ in range(50):
            p = _sigmoid(x @ w)
            w = w - np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (p - target) + (w - [1.0, 0.0])), -0.5, 0.5)
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])
        if (y == 1).any():
            kept = np.sort(self.probability(parts)[y == 1])
            self.threshold = float(kept[int(np.floor((1 - RECALL) * len(kept)))])

    def measure(self, parts: list[list[bytes]], y: np.ndarray) -> None:
        found = self.probability(parts) >= self.threshold
        self.report = {"secrets": int((y == 1).sum()), "others": int((y == 0).sum()), "recall": float(found[y == 1].mean()) if (y == 1).any() else 1.0, "precision": float((y[found] == 1).mean()) if found.any() else 1.0}

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, rate: float = 0.01) -> None:
        """Adam on the log loss; both labels weigh the same."""
        rng = np.random.default_rng(1)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                i = order[at : at + 64]
                grad = self._gradient(x[i], y[i], weight[i])
                step += 1
                for k, g in grad.items():
                    first, second = m[k]
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    self.p[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        logit, pooled, top, act = self._forward(x)
        d = (_sigmoid(logit) - y) * weight / len(y)
        back = d[:, None] * self.p["w"][None, :]
        d_act = np.repeat(back[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
        rows, filters = np.ogrid[: len(y), :FILTERS]
        d_act[rows, top, filters] += back[:, :FILTERS]
        d_act *= act > 0
        n = act.shape[1]
        d_e, d_k = np.zeros_like(self.p["e"]), np.zeros_like(self.p["k"])
        for o in range(WIDTH):
            codes = x[:, o : o + n]
            d_k[o] = np.einsum("bnd,bnf->df", self.p["e"][codes], d_act, optimize=True)
            np.add.at(d_e, codes.ravel(), (d_act @ self.p["k"][o].T).reshape(-1, DIMS))
        return {"e": d_e, "k": d_k, "b": d_act.sum(axis=(0, 1)), "w": pooled.T @ d, "c": d.sum(keepdims=True)}


def labelled(texts: list[bytes], rng: np.random.Generator, most: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Candidates (their windows) and labels from sample texts; at most 2 ``most`` secrets and 3 ``most`` others."""
    secret: list[list[bytes]] = []
    other: list[list[bytes]] = []
    places: list[tuple[bytes, int]] = []
    upper, lower, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + b"+/", upper + digits, lower + digits + b"_-"]
    for t in texts:
        found = base(t)
        secret += [windows(t, a, b) for a, b, kind in found if kind != "hex" or b - a >= 32]
        other += [windows(t, a, b) for a, b in candidates(t, found)]
        for _ in range(3):
            if len(t) > 200:
                a = int(rng.integers(100, len(t) - 64))
                if not any(s < a + 64 and e > a for s, e, _ in found):
                    other.append(windows(t, a, a + int(rng.integers(16, 40))))
                    places.append((t, a))
    for t, a in places[:most]:
        letters = np.frombuffer(alphabets[int(rng.integers(len(alphabets)))], np.uint8)
        key = letters[rng.integers(0, len(letters), int(rng.integers(20, 64)))].tobytes()
        secret.append(windows(t[:a] + b" " + key + b" " + t[a:], a + 1, a + 1 + len(key)))
    pick = lambda rows, k: [rows[j] for j in rng.permutation(len(rows))[:k]]
    secret, other = pick(secret, 2 * most), pick(other, 3 * most)
    return secret + other, np.array([1] * len(secret) + [0] * len(other))


def train(texts: list[bytes], seed: int = 0) -> Network:
    """A calibrated network, its threshold and report; the three parts share no text."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    fit, calibration, rest = (labelled(part, rng, most) for part, most in ((texts[0::5] + texts[1::5] + texts[2::5], SAMPLE_EACH), (texts[3::5], SAMPLE_EACH // 2), (texts[4::5], SAMPLE_EACH // 2)))
    if len(set(fit[1].tolist())) < 2 or len(set(calibration[1].tolist())) < 2:
        net.threshold = 1.1  # nothing to learn from: nothing is added
        return net
    x = np.frombuffer(b"".join(w for part in fit[0] for w in part), np.uint8).reshape(-1, _SIZE)
    net.fit(x, np.repeat(fit[1], list(map(len, fit[0]))))
    net.calibrate(*calibration)
    net.measure(*rest)
    return net


def findings(text: bytes, net: Network) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base findings, and all findings, of one text in bytes."""
    found = base(text)
    more = candidates(text, found)
    if not more:
        return found, found
    added = [(a, b, "net") for (a, b), q in zip(more, net.probability([windows(text, a, b) for a, b in more]), strict=True) if q >= net.threshold]
    return found, sorted(found + added, key=lambda x: (x[0], KINDS.index(x[2])))


def sample_network(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> Network:
    """Train on at most ``sample`` documents of at most SAMPLE_CHARS bytes: half of those with a digit run or keyword, half of any."""
    raw = docs.select(utf8(text_col).alias("bytes"), F.col(text_col).alias("text")).filter(F.length("bytes").between(1, SAMPLE_CHARS))
    likely = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]|[0-9a-f]{16}")
    marked = raw.select(F.xxhash64("bytes").alias("hash"), likely.alias("likely")).distinct()
    chosen = [r.hash for wanted in (True, False) for r in marked.filter(F.col("likely") == wanted).orderBy("hash").limit(sample // 2).collect()]
    found = texts_of(raw.select("bytes"), chosen)
    texts = [found[h] for h in chosen]
    return train(texts)


def joined(spans: list[tuple[int, int, str]], at: np.ndarray) -> str:
    return ",".join(f"{kind}:{at[a]}:{at[b]}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """Per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base``, ``spans`` (both kind:start:end in code points)."""
    held = docs.sparkSession.sparkContext.broadcast(net or sample_network(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in byte_values(b.column(1)):
                found, every = findings(text, held.value)
                at = char_starts(text) if every else None
                n = [sum(x[2] == k for x in found) for k in KINDS[:3]]
                for column, value in zip(out, (*n, joined(found, at), joined(every, at)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], names=[id_col, "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(id_col), utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", net: Network | None = None) -> DataFrame:
    """``docs`` with every finding's text replaced by [kind]; nothing else changes, null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(net or sample_network(docs, text_col))
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        raw = (text or "").encode()
        spans = findings(raw, held.value)[1]
        if not spans:
            return text
        out, last = [], 0
        for a, b, kind in spans:
            if b > last:
                out += [raw[last : max(a, last)], b"" if a < last else f"[{kind}]".encode()]
                last = b
        return b"".join([*out, raw[last:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(v.as_py()) for v in b.column(at)], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
