"""Decisions that depend on earlier decisions: folds over the ordered rows of one recording.

Each fold is a generator over the rows of one recording in order; ``fold`` runs it for every recording in the task that
holds the recording, so the work is spread by recording and bounded by the longest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixtures
from ..plans.query import with_views
from .resemblance import resembling

Rows = list[dict]
# Fixed values of the shaping rules.
PARAGRAPH, PARAGRAPH_GAP, LEAST_PARAGRAPH = 700, 2.5, 180
BREAK_PAUSE, OVERRUN = 1.0, 1.25
BATCH, LEAST_BATCH, BATCHES, SPARSE_SPAN = 3500, 700, 5, 180.0
CUT_GAP, CUTS, MAJOR = 3.0, 400, 2.5
CHAPTER_GAP, CHAPTERS = 10.0, 3
_ENDS = (".", "!", "?", "؟", "…")


def fold(rows: DataFrame, key: str, order: list[str], step: Callable[[Rows], Iterator[tuple]], schema: str) -> DataFrame:
    """``step`` over each key's rows in order; its tuples are the columns of ``schema`` behind the key."""
    return fold_together(rows, key, order, lambda groups: (step(rows) for rows in groups), schema)


def fold_together(rows: DataFrame, key: str, order: list[str], step: Callable[[list[Rows]], Iterable[Iterable[tuple]]], schema: str) -> DataFrame:
    """``step`` over the rows, in order, of some keys at a time; for each of them its tuples are the columns of ``schema`` behind the key.

    Rows are dealt by key and sorted, and a task walks over them batch by batch, holding a batch and one key's rows at a time:
    a key costs what its rows cost, however many keys there are.
    """
    dealt = rows.repartition(key).sortWithinPartitions(F.col(key), *[F.col(c).asc_nulls_last() for c in order])
    given = f"{key} {dict(rows.dtypes)[key]}, {schema}"
    arrow = to_arrow_schema(T.StructType.fromDDL(given))

    def done(groups: list[Rows]) -> Iterator[pa.RecordBatch]:
        out = [(rows[0][key], *x) for rows, found in zip(groups, step(groups), strict=True) for x in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[Rows] = []
        for batch in batches:
            for r in _records(batch):
                if not groups or r[key] != groups[-1][-1][key]:
                    groups.append([])
                groups[-1].append(r)
            yield from done(groups[:-1])
            groups = groups[-1:]
        yield from done(groups)

    return dealt.mapInArrow(run, given)


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries; a number that is null is no number, and so less than none."""
    names = batch.schema.names
    columns = [(c.fill_null(math.nan) if pa.types.is_floating(c.type) and c.null_count else c).to_pylist() for c in batch.columns]
    return (dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True))


def paragraphs(rows: Rows) -> Iterator[tuple]:
    """Paragraphs end before a segment when they hold PARAGRAPH characters already, or after a pause."""
    held: Rows = []
    for r in rows:
        if not r["text"]:
            continue
        if held and (sum(len(x["text"]) for x in held) >= PARAGRAPH or r["start_s"] - held[-1]["end_s"] >= PARAGRAPH_GAP):
            yield held[0]["start_s"], len(held), " ".join(x["text"] for x in held)
            held = []
        held.append(r)
    if held:
        yield held[0]["start_s"], len(held), " ".join(x["text"] for x in held)


def raw_paragraphs(rows: Rows) -> Iterator[tuple]:
    """Paragraphs of at most PARAGRAPH characters, ended early at a sentence's end past 60 % of that."""
    held: list[str] = []
    n = 0
    for r in rows:
        if held and n + 1 + len(r["text"]) > PARAGRAPH:
            yield len(held), " ".join(held)
            held, n = [], 0
        held.append(r["text"])
        n += len(r["text"]) + (n > 0)
        if n >= 0.6 * PARAGRAPH and r["text"].endswith(_ENDS):
            yield len(held), " ".join(held)
            held, n = [], 0
    if held:
        yield len(held), " ".join(held)


def batch_limit(total: int, span: float, most: int = BATCH) -> int:
    """Characters of a batch: a fifth of the text, but not under LEAST_BATCH, and less for little speech over a long time; ``most`` is the ceiling."""
    if total <= 0:
        return most
    least = max(150.0, total / 3) if span >= SPARSE_SPAN and total < 2 * LEAST_BATCH else float(LEAST_BATCH)
    return int(min(most, max(min(LEAST_BATCH, least), total / BATCHES)))


def batches(most: int = BATCH) -> Callable[[Rows], Iterator[tuple]]:
    """Whole segments packed in order into batches of a size that follows from the text; a longer one is a batch, an empty one is in none."""

    def step(rows: Rows) -> Iterator[tuple]:
        span = max(0.0, rows[-1]["end_s"] - rows[0]["start_s"]) if rows else 0.0
        sizes = [len(r["text"].strip()) for r in rows]
        limit = batch_limit(sum(sizes), span, most)
        number = n = 0
        for r, size in zip(rows, sizes, strict=True):
            if not size:
                continue
            if n and n + size > limit:
                number, n = number + 1, 0
            n += size
            yield r["segment_id"], number

    return step


def timeline(rows: Rows) -> Iterator[tuple]:
    """Sections and blocks from speech and figures in time order."""
    speech = [r for r in rows if r["kind"] == "segment"]
    after = {r["id"]: max(0.0, nxt["start_s"] - r["end_s"]) for r, nxt in zip(speech, speech[1:], strict=False)}
    stops = lambda r: r["text"].rstrip().endswith(_ENDS) or after.get(r["id"], float("inf")) >= BREAK_PAUSE
    length = min(600.0, max(40.0, max((r["start_s"] for r in rows), default=0.0) / 6))
    section, begun, block = -1, 0.0, 0
    held: Rows = []
    figures: Rows = []
    out: list[tuple] = []

    def flush(with_figures: bool) -> None:
        nonlocal block
        if text := " ".join(x["text"].strip() for x in held).strip():
            out.append((section, block, "paragraph", held[0]["start_s"], len(held), text))
            block += 1
        held.clear()
        if with_figures:
            for f in figures:
                out.append((section, block, "figure", f["start_s"], 0, str(f["id"])))
                block += 1
            figures.clear()

    for r in rows:
        passed = r["start_s"] - begun
        if section < 0 or passed >= length and (not held or stops(held[-1]) or passed >= length * OVERRUN):
            if section >= 0:
                flush(True)
            section, begun = section + 1, r["start_s"]
        if r["kind"] == "figure":
            figures.append(r)
            if not held or sum(len(x["text"]) for x in held) >= LEAST_PARAGRAPH and stops(held[-1]):
                flush(True)
            continue
        held.append(r)
        n = sum(len(x["text"]) for x in held)
        if figures and stops(r) and n >= LEAST_PARAGRAPH:
            flush(True)
        elif n >= PARAGRAPH and stops(r):
            flush(False)
        elif n >= 2 * PARAGRAPH:
            flush(True)
    if section >= 0:
        flush(True)
    yield from out


def merge_short(rows: Rows) -> Iterator[tuple]:
    """Short neighbours joined while they stay under PARAGRAPH; one figure between them is stepped over."""
    out: list[list] = []
    for r in rows:
        if r["kind"] == "paragraph":
            k = len(out) - 1
            if k >= 1 and out[k][1] == "figure" and out[k][0] == r["section_idx"]:
                k -= 1
            if k >= 0 and out[k][1] == "paragraph" and out[k][0] == r["section_idx"]:
                both = len(out[k][2]) + 1 + len(r["text"])
                if min(len(out[k][2]), len(r["text"])) < LEAST_PARAGRAPH and both <= PARAGRAPH:
                    out[k][2] += " " + r["text"]
                    continue
        out.append([r["section_idx"], r["kind"], r["text"]])
    for k, (section, kind, text) in enumerate(out):
        yield section, k, kind, text


def merge_sections(rows: Rows) -> Iterator[tuple]:
    """Consecutive sections about the same thing joined: titles that share half their rarer words, or near-equal texts."""
    words = [frozenset(w for w in r["title"].lower().split() if len(w) > 2) for r in rows]
    if len(rows) >= 6:
        common = {w for ws in words for w in ws if sum(w in x for x in words) >= 0.25 * len(rows)}
        words = [ws - common for ws in words]
    grams = [frozenset(zip(t, t[1:], t[2:], strict=False)) for t in (r["text"].lower().split() for r in rows)]
    into = 0
    for k, r in enumerate(rows):
        if k:
            shared = words[k] & words[into]
            alike = len(shared) >= 0.5 * max(1, min(len(words[k]), len(words[into]))) and len(shared) >= 3
            both = grams[k] | grams[into]
            if not alike and not (both and len(grams[k] & grams[into]) / len(both) >= 0.55):
                into = k
        yield r["section_idx"], rows[into]["section_idx"]


def chapters(rows: Rows) -> Iterator[tuple]:
    """Chapter marks: the first at 0, none within CHAPTER_GAP of the last kept, none so near the end; else none at all."""
    kept: list[tuple] = []
    for r in rows:
        at = 0.0 if not kept else r["start_s"]
        if not kept or at - kept[-1][0] >= CHAPTER_GAP:
            kept.append((at, r["title"]))
    end = max((r["end_s"] for r in rows), default=0.0)
    while kept and end - kept[-1][0] < CHAPTER_GAP:
        kept.pop()
    if len(kept) >= CHAPTERS:
        yield from ((k, at, title) for k, (at, title) in enumerate(kept))


def scene_cuts(gap: float = CUT_GAP, most: int = CUTS, major: float = MAJOR, early: bool = True) -> Callable[[Rows], Iterator[tuple]]:
    """Cuts over a recording's threshold and ``gap`` after the last one; ``major`` times the threshold needs no gap (``early``). The strongest ``most`` of them."""

    def step(rows: Rows) -> Iterator[tuple]:
        last, found = 0.0, []
        for r in rows:
            large = r["pixel_diff"] >= major * r["threshold"]
            if r["pixel_diff"] >= r["threshold"] and (r["ts"] - last >= gap or (large and early)):
                found.append((r["ts"], r["pixel_diff"], large))
                last = r["ts"]
        strongest = sorted(sorted(found, key=lambda x: -x[1])[:most])
        yield from ((k + 1, *cut) for k, cut in enumerate(strongest))

    return step


def spaced(gap: float = 3.0) -> Callable[[Rows], Iterator[tuple]]:
    """Frames at least ``gap`` after the last one kept."""

    def step(rows: Rows) -> Iterator[tuple]:
        last = float("-inf")
        for r in rows:
            if r["ts"] - last >= gap:
                last = r["ts"]
                yield (r["ts"],)

    return step


def frame_chunks(limit: int = 12, chars: int = 2000) -> Callable[[Rows], Iterator[tuple]]:
    """Frames in chunks of at most ``limit`` frames and ``chars`` characters of the speech between them."""

    def step(rows: Rows) -> Iterator[tuple]:
        chunk = n = said = 0
        for r in rows:
            if n and (n >= limit or said + r["said"] > chars):
                chunk, n, said = chunk + 1, 0, 0
            n, said = n + 1, said + r["said"]
            yield r["image_id"], chunk

    return step


def glossary_budget(limit: int = 400) -> Callable[[Rows], Iterator[tuple]]:
    """Ranked terms while they fit in ``limit`` characters; one that doesn't is passed over."""

    def step(rows: Rows) -> Iterator[tuple]:
        n = 0
        for r in rows:
            if n + len(r["term"]) + (2 if n else 0) <= limit:
                n += len(r["term"]) + (2 if n else 0)
                yield r["term"], n

    return step


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters of two texts, in lower case (no edit distance equals it)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fold_misreadings(ratio: float = 0.8) -> Callable[[Rows], Iterator[tuple]]:
    """Terms in rank order, each folded into the first kept one that it resembles; counts add up."""
    return lambda rows: iter(folded_together(ratio)([rows])[0])


def folded_together(ratio: float = 0.8) -> Callable[[list[Rows]], list[list[tuple]]]:
    """``fold_misreadings`` over many keys at a time."""

    def step(groups: list[Rows]) -> list[list[tuple]]:
        kept: list[dict[int, int]] = [{} for _ in groups]
        alive = [np.ones(len(rows), bool) for rows in groups]
        for g, low, high, later, earlier, _ in resembling([[r["term"].lower() for r in rows] for rows in groups], ratio, alive=alive):
            ends, earlier = np.searchsorted(later, np.arange(low, high + 1)).tolist(), earlier.tolist()
            for k in range(low, high):
                into = next((i for i in earlier[ends[k - low] : ends[k - low + 1]] if i in kept[g]), k)
                kept[g][into] = kept[g].get(into, 0) + groups[g][k]["n"]
                alive[g][k] = into == k
        return [[(rows[k]["term"], n) for k, n in found.items()] for rows, found in zip(groups, kept, strict=True)]

    return step


def resembling_pairs(ratio: float = 0.8) -> Callable[[list[Rows]], list[list[tuple]]]:
    """Every two terms of a key, in the order of its rows, that have ``ratio`` or more by sequence matching."""

    def step(groups: list[Rows]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in groups]
        for g, _, _, later, earlier, found in resembling([[r["term"] for r in rows] for rows in groups], ratio, swap=True):
            out[g] += [(groups[g][i]["term"], groups[g][k]["term"], x) for k, i, x in zip(later.tolist(), earlier.tolist(), found.round(6).tolist(), strict=True)]
        return out

    return step


def stable_threshold(rows: Rows) -> Iterator[tuple]:
    """Over a grid of k: cuts that each threshold gives, and the middle of the widest run of equal counts."""
    duration = max((r["ts"] for r in rows), default=0.0)
    runs: list[list] = []
    for step in range(2, 25):
        k, last, n = step / 4, 0.0, 0
        for r in rows:
            if r["pixel_diff"] >= r["mid"] + k * 1.4826 * r["mad"] and r["ts"] - last >= 1.0:
                last, n = r["ts"], n + 1
        if runs and runs[-1][0] == n:
            runs[-1][1].append(k)
        else:
            runs.append([n, [k]])
    inside = [r for r in runs if duration / 120 <= r[0] <= duration / 20] or runs
    best = max(inside, key=lambda r: len(r[1]))
    yield best[0], best[1][len(best[1]) // 2], len(best[1])


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.view(spark, sf_dir, "segments")
    return s.select("recording_id", "segment_id", "start_s", "end_s", F.coalesce("text_clean", "text_raw", F.lit("")).alias("text"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = _segments(spark, sf_dir).select("recording_id", F.lit("segment").alias("kind"), F.lit(1).alias("rank"), F.col("segment_id").cast("long").alias("id"), "start_s", "end_s", "text")
    frames = fixtures.view(spark, sf_dir, "keyframes").select(F.col("recording_id").cast("long").alias("recording_id"), F.lit("figure").alias("kind"), F.lit(0).alias("rank"), F.col("image_id").cast("long").alias("id"), F.col("ts").alias("start_s"), F.col("ts").alias("end_s"), F.lit("").alias("text"))
    return speech.withColumn("recording_id", F.col("recording_id").cast("long")).unionByName(frames)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, "plan_blocks")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame signals with the median, its deviation and the threshold of their recording."""
    s = fixtures.view(spark, sf_dir, "frame_signals")
    mid = s.groupBy("recording_id").agg(F.median("pixel_diff").alias("mid"))
    mad = s.join(mid, "recording_id").groupBy("recording_id", "mid").agg(F.median(F.abs(F.col("pixel_diff") - F.col("mid"))).alias("mad"))
    return s.join(mad, "recording_id").withColumn("threshold", F.greatest(F.lit(0.05), F.col("mid") + 1.0 * 1.4826 * F.col("mad")))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _blocks(spark, sf_dir).select("plan_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter(F.length("term") > 5)
    return words.groupBy("plan_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0).cast("long"), lambda s, i: s + F.when(F.get("embedding", i) > F.get("embedding", i - 1), F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("recording_id"), F.col("vec_id").alias("image_id"), bits.alias("bits"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a hypothesis lacks, of each clip."""
    pairs = fixtures.view(spark, sf_dir, "eval_pairs")
    return pairs.select("clip", (F.size(F.split("reference", " ")) - F.size(F.split("hypothesis", " "))).alias("errors"), F.size(F.split("reference", " ")).alias("words"))


def queries() -> dict:
    seg, blocks = _segments, _blocks
    sections = lambda s, d: blocks(s, d).groupBy("plan_id", "section_idx").agg(F.min_by(F.substring("text", 1, 60), "block_idx").alias("title"), F.listagg("text", F.lit(" ")).alias("text"), F.min("source_start").alias("start_s"), F.max("source_end").alias("end_s"))
    said = lambda s, d: _events(s, d).filter("kind = 'figure'").select("recording_id", F.col("id").alias("image_id"), F.col("start_s").alias("ts")).withColumn("said", (F.col("image_id") * 7919 % 900).cast("int"))
    return {
        "misread_pairs": misread_pairs,
        "batch_losses": lambda s, d: losses(seg(s, d).select("recording_id", F.col("segment_id").alias("id")), fold(seg(s, d), "recording_id", ["segment_id"], batches(), "segment_id long, batch int").select("recording_id", F.col("segment_id").alias("id")), None, "recording_id"),
        "transcript_paragraphs": lambda s, d: fold(seg(s, d), "recording_id", ["segment_id"], paragraphs, "start_s double, segments int, text string"),
        "raw_paragraphs": lambda s, d: fold(seg(s, d), "recording_id", ["segment_id"], raw_paragraphs, "segments int, text string"),
        "segment_batches": lambda s, d: fold(seg(s, d), "recording_id", ["segment_id"], batches(), "segment_id long, batch int"),
        "timeline_plan": lambda s, d: fold(_events(s, d), "recording_id", ["start_s", "rank", "id"], timeline, "section int, block int, kind string, start_s double, segments int, text string"),
        "merged_paragraphs": lambda s, d: fold(blocks(s, d).select("plan_id", "section_idx", "block_idx", "kind", "text"), "plan_id", ["block_idx"], merge_short, "section_idx int, block int, kind string, text string"),
        "merged_sections": lambda s, d: fold(sections(s, d).select("plan_id", "section_idx", "title", "text"), "plan_id", ["section_idx"], merge_sections, "section_idx int, into_section int"),
        "video_chapters": lambda s, d: fold(sections(s, d).drop("text"), "plan_id", ["start_s", "section_idx"], chapters, "chapter int, start_s double, title string"),
        "scene_cuts": lambda s, d: fold(_signals(s, d), "recording_id", ["ts"], scene_cuts(), "scene int, ts double, score double, major boolean"),
        "spaced_frames": lambda s, d: fold(_signals(s, d), "recording_id", ["ts"], spaced(), "ts double"),
        "frame_chunks": lambda s, d: fold(said(s, d), "recording_id", ["ts", "image_id"], frame_chunks(), "image_id long, chunk int"),
        "glossary_budget": lambda s, d: fold(_terms(s, d).select("plan_id", "term", (-F.col("n")).alias("minus")), "plan_id", ["minus", "term"], glossary_budget(), "term string, used int"),
        "folded_misreadings": lambda s, d: fold_together(_terms(s, d).withColumn("minus", -F.col("n")).withColumn("shorter", -F.length("term")), "plan_id", ["minus", "shorter", "term"], folded_together(), "term string, n long"),
        "bootstrap_interval": lambda s, d: bootstrap_interval(_pairs(s, d), "errors", "words"),
        "stable_threshold": lambda s, d: fold(_signals(s, d), "recording_id", ["ts"], stable_threshold, "cuts int, k double, width int"),
    }


def oracle_sql() -> dict[str, str]:
    """Folds as recursion over the rows of a recording."""
    return {
        "segment_batches": with_views(["segments"], f"""
WITH RECURSIVE t AS (SELECT recording_id, segment_id, length(trim(coalesce(text_clean, text_raw, ''))) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id) AS k, start_s, end_s FROM segments WHERE trim(coalesce(text_clean, text_raw, '')) <> ''),
l AS (SELECT recording_id, sum(n) AS total, greatest(0.0, (SELECT arg_max(end_s, segment_id) FROM segments s WHERE s.recording_id = t.recording_id) - (SELECT arg_min(start_s, segment_id) FROM segments s WHERE s.recording_id = t.recording_id)) AS span FROM t GROUP BY recording_id),
m AS (SELECT recording_id, CAST(floor(least({BATCH}, greatest(CASE WHEN span >= {SPARSE_SPAN} AND total < {2 * LEAST_BATCH} THEN least({LEAST_BATCH}, greatest(150.0, total / 3.0)) ELSE {LEAST_BATCH} END, total / {BATCHES}.0))) AS BIGINT) AS most FROM l),
r(recording_id, k, segment_id, batch, size) AS (
  SELECT recording_id, k, segment_id, 0, n FROM t WHERE k = 1
  UNION ALL SELECT t.recording_id, t.k, t.segment_id, r.batch + CASE WHEN r.size + t.n > most THEN 1 ELSE 0 END, CASE WHEN r.size + t.n > most THEN t.n ELSE r.size + t.n END FROM r JOIN t ON t.recording_id = r.recording_id AND t.k = r.k + 1 JOIN m ON m.recording_id = t.recording_id)
SELECT recording_id, segment_id, batch FROM r"""),
        "scene_cuts": with_views(["frame_signals"], f"""
WITH RECURSIVE mid AS (SELECT recording_id, median(pixel_diff) AS mid FROM frame_signals GROUP BY recording_id),
mad AS (SELECT f.recording_id, greatest(0.05, any_value(mid) + 1.4826 * median(abs(pixel_diff - mid))) AS threshold FROM frame_signals f JOIN mid ON mid.recording_id = f.recording_id GROUP BY f.recording_id),
t AS (SELECT f.recording_id, ts, pixel_diff, threshold, row_number() OVER (PARTITION BY f.recording_id ORDER BY ts) AS k FROM frame_signals f JOIN mad ON mad.recording_id = f.recording_id WHERE pixel_diff >= threshold),
r(recording_id, k, last, cut) AS (
  SELECT recording_id, 0, CAST(0 AS DOUBLE), false FROM mad
  UNION ALL SELECT t.recording_id, t.k, CASE WHEN ts - r.last >= {CUT_GAP} OR pixel_diff >= {MAJOR} * threshold THEN ts ELSE r.last END, ts - r.last >= {CUT_GAP} OR pixel_diff >= {MAJOR} * threshold FROM r JOIN t ON t.recording_id = r.recording_id AND t.k = r.k + 1),
c AS (SELECT t.recording_id, ts, pixel_diff AS score, pixel_diff >= {MAJOR} * threshold AS major, row_number() OVER (PARTITION BY t.recording_id ORDER BY pixel_diff DESC, ts) AS place FROM t JOIN r ON r.recording_id = t.recording_id AND r.k = t.k WHERE r.cut)
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY ts) AS INTEGER) AS scene, ts, score, major FROM c WHERE place <= {CUTS}"""),
    }


def misread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one plan that are readings of each other, with their ratio."""
    return fold_together(_terms(spark, sf_dir).drop("n"), "plan_id", ["term"], resembling_pairs(), "term string, other string, ratio double")


def losses(known: DataFrame, used: DataFrame, omitted: DataFrame | None, key: str) -> DataFrame:
    """Of each ``key``: ids that are neither used nor omitted, used but not known, used twice, and both used and omitted.

    Each frame has ``key`` and ``id``; ids are counted before they meet, so no group is larger than its distinct ids.
    """
    one = lambda df, name: df.groupBy(key, "id").agg(F.count(F.lit(1)).alias(name))
    omitted = omitted if omitted is not None else known.limit(0)
    met = one(known, "_known").join(one(used, "_used"), [key, "id"], "full").join(one(omitted, "_omitted"), [key, "id"], "full").fillna(0, ["_known", "_used", "_omitted"])
    counts = {"lost": (F.col("_known") > 0) & (F.col("_used") + F.col("_omitted") == 0), "invented": (F.col("_used") > 0) & (F.col("_known") == 0), "repeated": F.col("_used") > 1, "used_and_omitted": (F.col("_used") > 0) & (F.col("_omitted") > 0)}
    found = met.groupBy(key).agg(*[F.count_if(rule).alias(name) for name, rule in counts.items()])
    return found.withColumn("lossless", F.expr(" + ".join(counts)) == 0)


def bootstrap_interval(rows: DataFrame, errors: str, length: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """A 95 % interval of the pooled error rate by drawing clips again: the 51st and 1950th of ``rounds`` rates.

    How often a round draws a clip is a Poisson number of mean one that follows from a hash of both, so a run gives the
    same interval anywhere, no clip needs a number, and every task adds its clips up by round before anything is shuffled.
    Some column must tell clips apart: equal rows are drawn alike.
    """
    drawn = F.pmod(F.xxhash64("round", *rows.columns, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    weight, below, steps = F.lit(7), 0.0, []
    for k in range(7):  # the chances of 0 to 6 draws; more are as rare as one in ten thousand
        below += math.exp(-1) / math.factorial(k)
        steps.append((k, below))
    for k, most in reversed(steps):
        weight = F.when(drawn < most, F.lit(k)).otherwise(weight)
    each = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("times", weight)
    rates = each.groupBy("round").agg((F.sum(F.col("times") * F.col(errors)) / F.nullif(F.sum(F.col("times") * F.col(length)), F.lit(0))).alias("rate"))
    sorted_rates = F.array_sort(F.collect_list("rate"))
    return rates.agg(F.get(sorted_rates, F.lit(rounds * 50 // 2000)).alias("low"), F.get(sorted_rates, F.lit(rounds * 1949 // 2000)).alias("high"))
