"""Operators on the words of a segment: an array of (word, start_s, end_s, probability), each with its own times.

What concerns one segment is a fold over its array, inside its row; nothing is shuffled for it. Only what crosses
segments (gaps of a recording, captions that overlap) meets in a window of the recording.

A segment without words (null or empty) has its own times alone: it is one span, is never split, and is cut into captions of equal times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Built

WORD = "struct<word:string,start_s:double,end_s:double,probability:double>"
# Seconds of a silence that splits a segment, of the longest piece, of the least side of a cut; weights of a sentence's end and of the middle.
INNER_GAP, MAX_PIECE, MIN_SIDE = 2.5, 12.0, 2.5
SENTENCE, MIDDLE = 0.5, 0.25
CUT_ENDS = (".", "!", "?", "؟", "،", "؛", ":", "…")
# Limits of a caption, and of a piece that recognition can be trusted with.
CUE_SECONDS, CUE_CHARS, CUE_LEAST = 7.0, 84, 0.7
COMPRESSION, LOGPROB, NO_SPEECH, UNSURE = 2.4, -1.0, 0.6, -0.5
REFILL = 2.0


def _words(column: str = "words") -> Column:
    return F.coalesce(F.col(column), F.array().cast(f"array<{WORD}>"))


def spans(words: Column, least: float) -> Column:
    """(a, b) of the stretches of a segment's words between silences of ``least`` seconds or more."""

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], w["end_s"]).alias("b"))))
        fresh = F.concat(done, F.array(F.struct(w["start_s"].alias("a"), w["end_s"].alias("b"))))
        return F.when(F.size(done) == 0, fresh).when(w["start_s"] - F.get(done, F.size(done) - 1)["b"] >= least, fresh).otherwise(grown)

    real = F.array_sort(F.filter(words, lambda w: w["end_s"] > w["start_s"]), lambda x, y: F.when(x["start_s"] < y["start_s"], -1).when(x["start_s"] > y["start_s"], 1).otherwise(0))
    return F.aggregate(real, F.array().cast("array<struct<a:double,b:double>>"), step)


def gaps(segments: DataFrame, least: float = REFILL, durations: DataFrame | None = None) -> DataFrame:
    """Silences of ``least`` seconds or more between the words of a recording, seen inside long segments too.

    From 0 to the recording's duration (``durations``: recording_id, duration_s), or to its last word. Words less than ``least`` apart are one stretch
    before anything is shuffled: no silence that counts lies between them.
    """
    found = spans(_words(), least)
    whole = F.array(F.struct(F.col("start_s").cast("double").alias("a"), F.col("end_s").cast("double").alias("b")))
    laid = segments.select("recording_id", F.explode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("s")).select("recording_id", "s.*")
    if durations is not None:
        laid = laid.unionByName(durations.select("recording_id", F.col("duration_s").cast("double").alias("a"), F.col("duration_s").cast("double").alias("b")))
    before = F.coalesce(F.max("b").over(Window.partitionBy("recording_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return laid.withColumn("gap_start", before).filter(F.col("a") - F.col("gap_start") >= least).select("recording_id", F.round("gap_start", 3).alias("gap_start"), F.round("a", 3).alias("gap_end"))


def split_on_gaps(segments: DataFrame, silence: float = INNER_GAP) -> DataFrame:
    """Segments cut at every silence of more than ``silence`` seconds between two words (W05): ``piece``, times, ``words``, ``text``."""
    w = _words()
    n = F.size(w)
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(inner, lambda k: F.get(w, k)["start_s"] - F.get(w, k - 1)["end_s"] > silence)
    edges = segments.withColumn("_edges", F.concat(F.array(F.lit(0)), cuts, F.array(n)))
    each = edges.withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("_edges") - 2)))
    a, b = F.get("_edges", F.col("piece")), F.get("_edges", F.col("piece") + 1)
    part = F.slice(w, a + 1, b - a)
    first, last = F.col("piece") == 0, F.col("piece") == F.size("_edges") - 2
    cut = F.size("_edges") > 2
    return each.select(
        "recording_id", "segment_id", F.col("piece").cast("long").alias("piece"),
        F.when(first, F.col("start_s")).otherwise(F.get(w, a)["start_s"]).cast("double").alias("start_s"),
        F.when(last, F.col("end_s")).otherwise(F.get(w, b - 1)["end_s"]).cast("double").alias("end_s"),
        part.alias("words"), F.when(cut, F.array_join(F.transform(part, lambda x: x["word"]), " ")).otherwise(F.col("text_raw")).alias("text"),
    )


def best_cut(words: list[dict]) -> int | None:
    """Where a piece is cut: before the word behind the longest silence, a sentence's end and the middle counting too; both sides keep ``MIN_SIDE`` seconds."""
    begin, end = words[0]["start_s"], words[-1]["end_s"]
    middle, half = (begin + end) / 2, max(1e-6, (end - begin) / 2)
    best, where = -1.0, None
    for k in range(1, len(words)):
        left, right = words[k - 1], words[k]
        if left["end_s"] - begin < MIN_SIDE or end - right["start_s"] < MIN_SIDE:
            continue
        score = max(0.0, right["start_s"] - left["end_s"]) + SENTENCE * left["word"].rstrip().endswith(CUT_ENDS) + MIDDLE * (1 - abs(right["start_s"] - middle) / half)
        if score > best + 1e-9:  # the first of equals, whatever their last digits
            best, where = score, k
    return where


def split_long(segments: DataFrame, most: float = MAX_PIECE, silence: float = INNER_GAP) -> DataFrame:
    """Segments cut at silences, then pieces over ``most`` seconds at their best word border again and again (W06): ``piece`` from 0, times, ``n_words``, ``text``.

    How deep the cuts go follows from the words, so long pieces are cut by a function of one row; others never leave Spark.
    """
    pieces = split_on_gaps(segments, silence).withColumn("part", F.lit(0).cast("long"))
    long = (F.col("end_s") - F.col("start_s") > most) & (F.size("words") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                todo, part = [(0, len(r["words"]))], 0
                while todo:
                    i, j = todo.pop()
                    words = r["words"][i:j]
                    start = r["start_s"] if i == 0 else words[0]["start_s"]
                    end = r["end_s"] if j == len(r["words"]) else words[-1]["end_s"]
                    k = best_cut(words) if end - start > most and len(words) > 1 else None
                    if k is not None:
                        todo += [(i + k, j), (i, i + k)]
                        continue
                    text = r["text"] if (i, j) == (0, len(r["words"])) else " ".join(w["word"] for w in words)
                    out.append(r | {"start_s": start, "end_s": end, "words": words, "text": text, "part": part})
                    part += 1
            yield pa.RecordBatch.from_pylist(out, b.schema)

    cut = pieces.filter(~long | long.isNull()).unionByName(pieces.filter(long).mapInArrow(run, pieces.schema))
    order = Window.partitionBy("recording_id", "segment_id").orderBy("piece", "part")
    return cut.select("recording_id", "segment_id", (F.row_number().over(order) - 1).cast("long").alias("piece"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.size("words").cast("long").alias("n_words"), "text")


def cues(segments: DataFrame) -> DataFrame:
    """Captions (W14): ``cue`` from 1, times, ``text``.

    A segment over ``CUE_SECONDS`` is packed word by word; a cue is full at ``CUE_SECONDS`` or ``CUE_CHARS`` letters, and the next begins where
    its last word ended. A caption lasts ``CUE_LEAST`` at least, ends where the next one begins, and goes if nothing is left of it.
    """
    text = F.trim(F.coalesce(F.when(F.col("text_clean") != "", F.col("text_clean")), F.col("text_raw"), F.lit("")))
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    said = F.filter(_words(), lambda w: F.trim(F.coalesce(w["word"], F.lit(""))) != "")
    cue = lambda a, b, t: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), t.alias("t"))

    def step(s: Column, w: Column) -> Column:
        held = F.when(s["held"] == "", F.trim(w["word"])).otherwise(F.concat_ws(" ", s["held"], F.trim(w["word"])))
        full = (w["end_s"] - s["start"] >= CUE_SECONDS) | (F.length(held) >= CUE_CHARS)
        done = F.when(full, F.concat(s["done"], F.array(cue(s["start"], w["end_s"], held)))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, w["end_s"]).otherwise(s["start"]).alias("start"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    none = F.array().cast("array<struct<a:double,b:double,t:string>>")
    begin = F.struct(none.alias("done"), F.get(said, F.lit(0))["start_s"].alias("start"), F.lit("").alias("held"))
    end = F.get(said, F.size(said) - 1)["end_s"]
    packed = F.aggregate(said, begin, step, lambda s: F.when(s["held"] != "", F.concat(s["done"], F.array(cue(s["start"], end, s["held"])))).otherwise(s["done"]))

    parts = F.greatest(F.lit(2), F.floor(length / CUE_SECONDS).cast("int") + 1)
    tokens = F.split(text, r"\s+")
    per = F.greatest(F.lit(1), F.floor(F.size(tokens) / parts).cast("int"))
    some = lambda k: F.slice(tokens, k * per + 1, F.when(k < parts - 1, per).otherwise(F.greatest(F.lit(0), F.size(tokens) - k * per)))
    even = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: cue(F.col("start_s") + k * length / parts, F.col("start_s") + (k + 1) * length / parts, F.array_join(some(k), " ")))
    laid = F.when(text == "", none).when(length <= CUE_SECONDS, F.array(cue(F.col("start_s"), F.col("end_s"), text))).when(F.size(said) > 0, packed).otherwise(even)
    rows = segments.select("recording_id", "segment_id", F.posexplode(laid).alias("k", "c")).select("recording_id", "segment_id", "k", F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.trim(F.regexp_replace("c.t", r"\s+", " ")).alias("text")).filter("text <> ''")
    order = Window.partitionBy("recording_id").orderBy("segment_id", "k")
    rows = rows.withColumn("b", F.greatest("b", F.col("a") + CUE_LEAST)).withColumn("b", F.least("b", F.coalesce(F.lead("a").over(order), F.col("b")))).filter("b > a")
    return rows.select("recording_id", F.row_number().over(order).cast("long").alias("cue"), F.round("a", 3).alias("start_s"), F.round("b", 3).alias("end_s"), "text")


def trusted(pieces: DataFrame) -> DataFrame:
    """Pieces whose recognition can be trusted (P10); a measure that is missing speaks against none."""
    bad = (F.col("compression") > COMPRESSION) | (F.col("logprob") < LOGPROB) | ((F.col("no_speech") > NO_SPEECH) & (F.col("logprob") < UNSURE))
    return pieces.filter(~F.coalesce(F.col("compression") > COMPRESSION, F.lit(False)) & ~F.coalesce(F.col("logprob") < LOGPROB, F.lit(False)) & ~F.coalesce(bad, F.lit(False)))


_EACH = "SELECT recording_id, segment_id, start_s AS s, end_s AS e, text_raw, text_clean, unnest(words) AS w, generate_subscripts(words, 1) AS k, len(words) AS n FROM timed_segments"

QUERIES = [
    Built("word_gaps", "W02", ["timed_segments"], lambda timed_segments: gaps(timed_segments), f"""
WITH w AS ({_EACH}),
x AS (SELECT recording_id, w.start_s AS a, w.end_s AS b FROM w WHERE w.end_s > w.start_s UNION ALL SELECT recording_id, start_s, end_s FROM timed_segments WHERE coalesce(len(words), 0) = 0),
g AS (SELECT recording_id, a, coalesce(max(b) OVER (PARTITION BY recording_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c FROM x)
SELECT recording_id, round(c, 3) AS gap_start, round(a, 3) AS gap_end FROM g WHERE a - c >= {REFILL}"""),
    Built("split_on_gaps", "W05", ["timed_segments"], lambda timed_segments: split_on_gaps(timed_segments).withColumns({"n_words": F.size("words").cast("long"), "start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)}).drop("words"), f"""
WITH w AS ({_EACH}),
f AS (SELECT *, CASE WHEN w.start_s - lag(w.end_s) OVER (PARTITION BY recording_id, segment_id ORDER BY k) > {INNER_GAP} THEN 1 ELSE 0 END AS cut FROM w),
p AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id, segment_id ORDER BY k) AS piece FROM f)
SELECT recording_id, segment_id, CAST(piece AS BIGINT) AS piece, round(CASE WHEN min(k) = 1 THEN any_value(s) ELSE min(w.start_s) END, 3) AS start_s, round(CASE WHEN max(k) = any_value(n) THEN any_value(e) ELSE max(w.end_s) END, 3) AS end_s,
       CASE WHEN count(*) = any_value(n) THEN any_value(text_raw) ELSE string_agg(w.word, ' ' ORDER BY k) END AS text, count(*) AS n_words FROM p GROUP BY recording_id, segment_id, piece
UNION ALL SELECT recording_id, segment_id, 0, start_s, end_s, text_raw, 0 FROM timed_segments WHERE coalesce(len(words), 0) = 0"""),
    Built("split_long", "W06", ["timed_segments"], lambda timed_segments: split_long(timed_segments), f"""
WITH RECURSIVE w AS ({_EACH}),
f AS (SELECT *, CASE WHEN w.start_s - lag(w.end_s) OVER (PARTITION BY recording_id, segment_id ORDER BY k) > {INNER_GAP} THEN 1 ELSE 0 END AS cut FROM w),
g AS (SELECT *, sum(cut) OVER (PARTITION BY recording_id, segment_id ORDER BY k) AS piece FROM f),
first AS (SELECT recording_id, segment_id, CAST(min(k) AS BIGINT) AS i, CAST(max(k) AS BIGINT) AS j FROM g GROUP BY recording_id, segment_id, piece),
r(recording_id, segment_id, i, j) AS (
  SELECT recording_id, segment_id, i, j FROM first
  UNION ALL
  SELECT recording_id, segment_id, CASE WHEN side = 0 THEN i ELSE best END, CASE WHEN side = 0 THEN best - 1 ELSE j END FROM (
    SELECT recording_id, segment_id, i, j, arg_min(k, (-round(greatest(0.0, ws[k].start_s - ws[k - 1].end_s) + CASE WHEN regexp_matches(ws[k - 1].word, '[.!?؟،؛:…]\\s*$') THEN {SENTENCE} ELSE 0 END
             + {MIDDLE} * (1 - abs(ws[k].start_s - (ws[i].start_s + ws[j].end_s) / 2) / greatest(1e-6, (ws[j].end_s - ws[i].start_s) / 2)), 8), k)) AS best
    FROM (SELECT r.*, t.words AS ws, unnest(range(r.i + 1, r.j + 1)) AS k FROM r JOIN timed_segments t ON t.recording_id = r.recording_id AND t.segment_id = r.segment_id
          WHERE (CASE WHEN r.j = len(t.words) THEN t.end_s ELSE t.words[r.j].end_s END) - (CASE WHEN r.i = 1 THEN t.start_s ELSE t.words[r.i].start_s END) > {MAX_PIECE})
    WHERE ws[k - 1].end_s - ws[i].start_s >= {MIN_SIDE} AND ws[j].end_s - ws[k].start_s >= {MIN_SIDE}
    GROUP BY recording_id, segment_id, i, j), (VALUES (0), (1)) AS sides(side)),
leaf AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.recording_id = r.recording_id AND q.segment_id = r.segment_id AND q.i >= r.i AND q.j <= r.j AND q.j - q.i < r.j - r.i)),
o AS (SELECT l.recording_id, l.segment_id, l.i, l.j, CASE WHEN l.i = 1 THEN any_value(s) ELSE min(w.start_s) END AS start_s, CASE WHEN l.j = any_value(n) THEN any_value(e) ELSE max(w.end_s) END AS end_s, count(*) AS n_words,
             CASE WHEN count(*) = any_value(n) THEN any_value(text_raw) ELSE string_agg(w.word, ' ' ORDER BY k) END AS text
      FROM leaf l JOIN w ON w.recording_id = l.recording_id AND w.segment_id = l.segment_id AND w.k BETWEEN l.i AND l.j GROUP BY l.recording_id, l.segment_id, l.i, l.j)
SELECT recording_id, segment_id, row_number() OVER (PARTITION BY recording_id, segment_id ORDER BY i) - 1 AS piece, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, n_words, text FROM o
UNION ALL SELECT recording_id, segment_id, 0, start_s, end_s, 0, text_raw FROM timed_segments WHERE coalesce(len(words), 0) = 0"""),
    Built("caption_cues", "W14", ["timed_segments"], lambda timed_segments: cues(timed_segments), f"""
WITH RECURSIVE t AS (SELECT *, trim(coalesce(nullif(text_clean, ''), text_raw, '')) AS said FROM timed_segments),
w AS (SELECT recording_id, segment_id, k, n, trim(w.word) AS word, w.start_s AS a, w.end_s AS b FROM ({_EACH}) JOIN t USING (recording_id, segment_id) WHERE t.said <> '' AND t.end_s - t.start_s > {CUE_SECONDS}),
p(recording_id, segment_id, k, n, start, b, held, full_at) AS (
  SELECT recording_id, segment_id, k, n, a, b, word, b - a >= {CUE_SECONDS} OR length(word) >= {CUE_CHARS} FROM w WHERE k = 1
  UNION ALL
  SELECT w.recording_id, w.segment_id, w.k, w.n, CASE WHEN full_at THEN p.b ELSE p.start END, w.b, CASE WHEN full_at THEN w.word ELSE p.held || ' ' || w.word END,
         w.b - CASE WHEN full_at THEN p.b ELSE p.start END >= {CUE_SECONDS} OR length(CASE WHEN full_at THEN w.word ELSE p.held || ' ' || w.word END) >= {CUE_CHARS}
  FROM p JOIN w ON w.recording_id = p.recording_id AND w.segment_id = p.segment_id AND w.k = p.k + 1),
q AS (SELECT *, string_split_regex(said, '\\s+') AS ts, greatest(2, CAST(floor((end_s - start_s) / {CUE_SECONDS}) AS BIGINT) + 1) AS parts FROM t WHERE said <> '' AND end_s - start_s > {CUE_SECONDS} AND coalesce(len(words), 0) = 0),
v AS (SELECT *, unnest(range(parts)) AS k, greatest(1, len(ts) // parts) AS per FROM q),
c AS (SELECT recording_id, segment_id, k, start AS a, b, held AS text FROM p WHERE full_at OR k = n
      UNION ALL SELECT recording_id, segment_id, 0, start_s, end_s, said FROM t WHERE said <> '' AND end_s - start_s <= {CUE_SECONDS}
      UNION ALL SELECT recording_id, segment_id, k, start_s + k * (end_s - start_s) / parts, start_s + (k + 1) * (end_s - start_s) / parts, array_to_string(ts[k * per + 1 : CASE WHEN k < parts - 1 THEN (k + 1) * per ELSE len(ts) END], ' ') FROM v),
m AS (SELECT recording_id, segment_id, k, a, greatest(b, a + {CUE_LEAST}) AS b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM c WHERE trim(text) <> ''),
l AS (SELECT *, least(b, coalesce(lead(a) OVER (PARTITION BY recording_id ORDER BY segment_id, k), b)) AS z FROM m)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id, k) AS cue, round(a, 3) AS start_s, round(z, 3) AS end_s, text FROM l WHERE z > a"""),
    Built("untrusted_pieces", "P10", ["timed_segments"], lambda timed_segments: trusted(timed_segments).select("recording_id", "segment_id"), f"""
SELECT recording_id, segment_id FROM timed_segments
WHERE CASE WHEN compression > {COMPRESSION} THEN false WHEN logprob < {LOGPROB} THEN false WHEN no_speech > {NO_SPEECH} AND logprob < {UNSURE} THEN false ELSE true END"""),
]
