"""Spelling variants of words by pivotal grams: words one inserted, deleted or replaced letter apart, and the form each is taken for.

Bigrams are put in one order, rarest first; a word's prefix are its three first ones (with all that equal the third). Two of
them that don't overlap are its pivots, chosen by dynamic programming for the least sum of frequencies. One edit can't touch
both pivots: it is behind the left one, or before the right one. So of two near words, the one whose prefix ends earlier has its left pivot
in the other one's prefix at the same place from the start, with equal text before it; or its right one at the same place from the end, with equal
text behind it. Those sides, pivot included, are its keys, with the lengths that the other word may have; a prefix gram's are the
same with its own length. Pairs with an equal key, whose letters (odd counts) differ in two kinds at most, are verified by their edit distance,
those of short words where they meet.

Words are runs of Latin letters up to U+00FF, so there are at most 2**16 bigrams, whose frequencies are broadcast. Texts
are only read to count words, partly in each task; what comes after is of the size of the vocabulary. Keys are hashes and words
are joined to them by hashes: equal hashes of unequal words cost a comparison and change nothing. A word's form has at least twice its count,
so chains of forms are short and free of cycles; they are followed by pointer jumps over written tables.

Cases: null and empty texts have no words; every row counts, repeated ones too; a null id is written as the empty text where
an id decides which letter is lost; words are of any length; ties go to the word first in code-point order; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

LETTERS = "A-Za-zÀ-ÿ"
#: A letter is lost where this divides a run's checksum; letters and occurrences of a word at least; how many times more a form occurs.
LOST, LENGTH, COUNT, TIMES = 97, 5, 3, 2
PREFIX = 3
#: Words of so many letters or fewer travel with their keys, and their pairs are verified where they meet; others go by hash and are verified after.
SHORT = 32
_BITS = np.left_shift(np.ones(64, np.uint64), np.arange(64, dtype=np.uint64)).view(np.int64)


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``word``, ``n``): words of enough letters and occurrences, after letters are lost. Written."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run"))
    low = runs.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run")).filter(F.length("run") >= LENGTH)
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % LOST == 0, shorter).otherwise(F.col("run"))
    counted = low.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.filter((F.col("n") >= COUNT) & (F.length("word") >= LENGTH)), "words")


def _grams(word: bytes) -> list[int]:
    return [a << 8 | b for a, b in zip(word, word[1:], strict=False)]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words hold each bigram of Latin-1 letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            found = [g for w in b.column(0) for g in set(_grams(w.as_py().encode("latin-1")))]
            total += np.bincount(np.array(found, np.int64), minlength=1 << 16)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], names=["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 2**16 rows
        out[r.gram] = r.n
    return out


def prefix_of(ranks: list[int]) -> tuple[list[int], int]:
    """Places of a word's prefix grams, and the rank that ends it."""
    last = sorted(ranks)[PREFIX - 1]
    return [k for k, r in enumerate(ranks) if r <= last], last


def pivots_of(places: list[int], weights: list[int]) -> tuple[int, int]:
    """Two places at least two apart with the least sum of weights; ``places`` rise and hold such two.

    ``free`` is the best of all places before the last one, which are at least two before the next.
    """
    free = last = best = None
    for place, weight in zip(places, weights, strict=True):
        reach = free
        if last and last[1] <= place - 2:
            reach = min(free or last, last)
        if reach and (best is None or reach[0] + weight < best[0]):
            best = (reach[0] + weight, reach[1], place)
        if last:
            free = min(free or last, last)
        last = (weight, place)
    return best[1], best[2]


def left_keys(word: bytes, places: list[int], length: int) -> Iterator[int]:
    """A key of the word up to the end of each gram, with the length of the prefix's word; ``places`` rise."""
    h = xxhash.xxh64(seed=length)
    at = 0
    for p in places:
        h.update(word[at : p + 2])
        at = p + 2
        yield h.intdigest()


def right_keys(word: bytes, places: list[int], length: int) -> Iterator[int]:
    """The same from the begin of each gram to the word's end."""
    return left_keys(word[::-1], [len(word) - p - 2 for p in reversed(places)], -length % (1 << 64))


def letters_of(word: bytes) -> int:
    """A bit for each letter (modulo 64) of odd count, as a signed long: one edit changes two at most."""
    return int(np.bitwise_xor.reduce(_BITS[np.frombuffer(word, np.uint8) & 63]))


def keys(words: DataFrame, counts: np.ndarray, pivots: bool) -> DataFrame:
    """(``key``, ``id``, ``last``, ``letters``, ``short``: the word, if it is no longer than ``SHORT``) of the pivots, or of the prefix grams, of every word. Not written."""
    order = np.lexsort((np.arange(1 << 16), counts))
    rank = np.empty(1 << 16, np.int64)
    rank[order] = np.arange(1 << 16)
    held = words.sparkSession.sparkContext.broadcast((rank.tolist(), counts.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, weights = held.value
        for b in batches:
            found, ids, lasts, letters, short = [], [], [], [], []
            for word, own in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                w = word.as_py().encode("latin-1")
                grams = _grams(w)
                places, last = prefix_of([ranks[g] for g in grams])
                before = len(found)
                if pivots:
                    left, right = pivots_of(places, [weights[grams[p]] for p in places])
                    for length in (len(w) - 1, len(w), len(w) + 1):
                        found += left_keys(w, [left], length)
                        found += right_keys(w, [right], length)
                else:
                    found += left_keys(w, places, len(w))
                    found += right_keys(w, places, len(w))
                n = len(found) - before
                ids += [own] * n
                lasts += [last] * n
                letters += [letters_of(w)] * n
                short += [word.as_py() if len(w) <= SHORT else None] * n
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in (ids, lasts, letters)), pa.array(short, pa.string())], names=["key", "id", "last", "letters", "short"])

    return words.select("word", F.xxhash64("word").alias("id")).mapInArrow(run, "key long, id long, last long, letters long, short string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(``word``, ``other``, ``other_n``) of all words one edit apart, both ways. Not written."""
    counts = gram_counts(words)
    mine = keys(words, counts, True).toDF("key", "a", "mine", "x", "v")
    theirs = keys(words, counts, False).toDF("key", "b", "theirs", "y", "w")
    met = mine.join(theirs, "key").filter("a <> b AND mine <= theirs AND bit_count(x ^ y) <= 2").filter(F.coalesce(F.levenshtein("v", "w", 1) == 1, F.lit(True))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = words.withColumn("id", F.xxhash64("word"))
    left, right = known.toDF("w", "w_n", "a"), known.toDF("v", "v_n", "b")
    pairs = written(met.join(left, "a").join(right, "b").filter(F.levenshtein("w", "v", 1) == 1).select("w", "w_n", "v", "v_n"), "near")
    return pairs.select(F.col("w").alias("word"), F.col("v").alias("other"), F.col("v_n").alias("other_n")).unionByName(pairs.select(F.col("v").alias("word"), F.col("w").alias("other"), F.col("w_n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): where the chain that begins with each word's ``form`` ends."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        then = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        moved = then.filter("moved").limit(1).count()
        discard(now)
        path, now = then._kymo_path, then.drop("moved")
        now._kymo_path = path
        if not moved:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = vocabulary(docs, id_col, text_col)
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("top"))
    taken = F.col("top.minus") * -1 >= TIMES * F.col("n")
    found = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("top.other")).alias("form"), F.when(taken, -F.col("top.minus")).alias("form_n")), "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS times FROM (SELECT doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM runs) WHERE length(run) >= {LENGTH} GROUP BY ALL),
byte AS (SELECT *, list_transform(range(CAST(length(hex(encode(named))) / 2 AS BIGINT)), lambda i : CAST('0x' || substr(hex(encode(named)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM low),
crc AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b : xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM byte),
lost AS (SELECT times, CASE WHEN h % {LOST} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM lost WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(times) >= {COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
one AS (SELECT DISTINCT d.word AS long, d.n AS long_n, w.word AS short, w.n AS short_n FROM d JOIN w ON w.word = d.less),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
         UNION ALL SELECT long, short, short_n FROM one UNION ALL SELECT short, long, long_n FROM one),
top AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n FROM w LEFT JOIN top ON top.word = w.word),
r(word, root, next) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""
