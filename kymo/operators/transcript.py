"""Transcript shaping: gaps, pauses, loops, captions, coverage. Every recording is a window partition of its own."""

from __future__ import annotations

from ..plans.query import Query

_W = "PARTITION BY recording_id ORDER BY start_s, segment_id"
LONG_GAP = 30.0

_GAPS = """
m AS (SELECT recording_id, start_s, end_s, segment_id, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_s FROM {segments}),
e AS (SELECT recording_id, max(end_s) AS last_s FROM {segments} GROUP BY recording_id),
g AS (SELECT recording_id, coalesce(before_s, 0.0) AS gap_start, start_s AS gap_end FROM m
      UNION ALL SELECT recording_id, last_s, last_s + 10.0 FROM e)"""

#: Fixed value: spoken fillers.
FILLERS = r"(?iU)\b(?:يعني|طيب|أه+|امم+|اه+|اللي\s+هو|بقى|كده|ماشي|okay|ok)\b"


def _gaps(d) -> str:
    return _GAPS.format(segments=d.segments)


def _loop_key(d) -> str:
    """The whole text composed, without vowel marks and punctuation, single spaces."""
    key = "reflect('com.ibm.icu.text.Normalizer', 'compose', coalesce(text_raw, ''), false)"
    for pattern, by in ((r"[\u0610-\u061a\u064b-\u065f\u06d6-\u06ed]", ""), (r"(?U)[^\p{L}\p{N}_\s]", ""), (r"(?U)\s+", " ")):
        key = d.replace(key, pattern, by)
    return f"trim({key})"


QUERIES = [
    Query("effective_text", "P01", ["segments"], lambda d: f"SELECT recording_id, segment_id, coalesce(nullif(text_clean, ''), text_raw, '') AS text FROM {d.segments}"),
    Query("segment_checks", "P02", ["segments"], lambda d: f"SELECT recording_id, segment_id, end_s >= start_s AND start_s >= 0 AS valid FROM {d.segments}"),
    Query("recording_checks", "P02", ["job_facts"], lambda d: f"SELECT duration_seconds > 0 AS valid, count(*) AS n FROM {d.job_facts} GROUP BY duration_seconds > 0"),
    Query("clip_shift", "P03", ["segments"], lambda d: f"""
SELECT recording_id, segment_id, round(greatest(start_s, 10.0) - 10.0, 3) AS start_s, round(least(end_s, 60.0) - 10.0, 3) AS end_s
FROM {d.segments} WHERE end_s > 10.0 AND start_s < 60.0"""),
    Query("transcript_gaps", "W01", ["segments"], lambda d: f"WITH {_gaps(d)} SELECT recording_id, round(gap_start, 3) AS gap_start, round(gap_end, 3) AS gap_end FROM g WHERE gap_end - gap_start >= 1.0"),
    Query("transcript_completeness", "W01 A07", ["segments"], lambda d: f"""
WITH {_gaps(d)},
t AS (SELECT recording_id, max(end_s) + 10.0 AS duration, sum(greatest(0.0, end_s - start_s)) AS spoken, sum(n_words) AS words FROM {d.segments} GROUP BY recording_id),
k AS (SELECT recording_id, max(gap_end - gap_start) AS longest, sum(CASE WHEN gap_end - gap_start >= {LONG_GAP} THEN 1 ELSE 0 END) AS long_gaps FROM g GROUP BY recording_id)
SELECT t.recording_id, round(least(100.0, 100.0 * spoken / nullif(duration, 0)), 4) AS coverage_percent, CAST(words AS BIGINT) AS words,
       round(words * 60.0 / nullif(duration, 0), 4) AS words_per_minute, round(longest, 3) AS longest_gap, CAST(long_gaps AS BIGINT) AS long_gaps
FROM t JOIN k ON t.recording_id = k.recording_id"""),
    Query("pauses_after", "W03", ["segments"], lambda d: f"""
SELECT recording_id, segment_id, round(coalesce(greatest(0.0, lead(start_s) OVER (PARTITION BY recording_id ORDER BY segment_id) - end_s), 1e9), 3) AS pause_s FROM {d.segments}"""),
    Query("collapsed_repeats", "W04 F05", ["segments"], lambda d: f"""
WITH k AS (SELECT recording_id, segment_id, start_s, end_s, text_raw, {_loop_key(d)} AS loop_key FROM {d.segments}),
f AS (SELECT *, CASE WHEN loop_key <> '' AND length(loop_key) <= 60 AND loop_key = lag(loop_key) OVER (PARTITION BY recording_id ORDER BY segment_id) THEN 0 ELSE 1 END AS fresh FROM k),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY segment_id) AS island FROM f),
n AS (SELECT *, count(*) OVER (PARTITION BY recording_id, island) AS len FROM i),
g AS (SELECT recording_id, CASE WHEN len >= 3 THEN -island ELSE segment_id END AS grp, segment_id, start_s, end_s, text_raw FROM n)
SELECT recording_id, min(segment_id) AS first_id, count(*) AS merged, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s, {d.join('text_raw', ' ', 'segment_id')} AS text_raw
FROM g GROUP BY recording_id, grp""", sql=r"""
WITH k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text_raw, '')), '[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{06d6}-\x{06ed}]', '', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS loop_key FROM segments),
n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id) AS r FROM k),
i AS (SELECT *, r - row_number() OVER (PARTITION BY recording_id, loop_key ORDER BY segment_id) AS island, loop_key <> '' AND length(loop_key) <= 60 AS loops FROM n),
c AS (SELECT *, loops AND count(*) OVER (PARTITION BY recording_id, loop_key, island) >= 3 AS merges FROM i)
SELECT recording_id, min(segment_id) AS first_id, count(*) AS merged, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s, string_agg(text_raw, ' ' ORDER BY segment_id) AS text_raw
FROM c GROUP BY recording_id, loop_key, island, CASE WHEN merges THEN 0 ELSE segment_id END"""),
    Query("cue_trim", "W14", ["segments"], lambda d: f"""
WITH c AS (SELECT recording_id, segment_id, start_s, greatest(end_s + 0.6, start_s + 0.7) AS end_s FROM {d.segments}),
n AS (SELECT *, lead(start_s) OVER (PARTITION BY recording_id ORDER BY start_s, segment_id) AS next_s FROM c)
SELECT recording_id, segment_id, round(start_s, 3) AS start_s, round(least(end_s, coalesce(next_s, end_s)), 3) AS end_s FROM n WHERE least(end_s, coalesce(next_s, end_s)) > start_s"""),
    Query("word_confidence", "A08", ["ocr_words"], lambda d: f"""
WITH p AS (SELECT image_id AS recording_id, line AS segment_id, conf / 100.0 AS probability FROM {d.ocr_words}),
s AS (SELECT recording_id, segment_id, avg(probability) AS mean_p FROM p GROUP BY recording_id, segment_id),
a AS (SELECT recording_id, avg(probability) AS mean_p, 100.0 * sum(CASE WHEN probability < 0.5 THEN 1 ELSE 0 END) / count(*) AS weak FROM p GROUP BY recording_id),
b AS (SELECT recording_id, sum(CASE WHEN mean_p < 0.6 THEN 1 ELSE 0 END) AS weak_segments FROM s GROUP BY recording_id)
SELECT a.recording_id, round(a.mean_p, 6) AS mean_probability, round(weak, 4) AS weak_percent, CAST(weak_segments AS BIGINT) AS weak_segments FROM a JOIN b ON a.recording_id = b.recording_id"""),
    Query("full_text", "A32", ["segments"], lambda d: f"SELECT recording_id, {d.join('text_clean', ' ', 'segment_id')} AS full_text FROM {d.segments} WHERE trim(coalesce(text_clean, '')) <> '' GROUP BY recording_id"),
    Query("speech_ratio", "A30", ["segments"], lambda d: f"""
WITH s AS (SELECT recording_id, end_s AS a, coalesce(lead(start_s) OVER (PARTITION BY recording_id ORDER BY segment_id), end_s) AS b FROM {d.segments}),
w AS (SELECT DISTINCT recording_id, CAST(floor(start_s / 20) AS BIGINT) AS win FROM {d.segments})
SELECT w.recording_id, w.win, round(greatest(0.0, least(1.0, 1.0 - coalesce(sum(greatest(0.0, least(b, (win + 1) * 20.0) - greatest(a, win * 20.0))), 0.0) / 20.0)), 6) AS speech_ratio
FROM w LEFT JOIN s ON s.recording_id = w.recording_id AND s.a < (win + 1) * 20.0 AND s.b > win * 20.0 GROUP BY w.recording_id, w.win"""),
    Query("filler_rate", "A15", ["segments"], lambda d: f"""
SELECT recording_id, round(1000.0 * sum({d.size(d.found('text_raw', FILLERS))}) / nullif(sum(n_words), 0), 4) AS fillers_per_1000 FROM {d.segments} GROUP BY recording_id""", sql="""
WITH t AS (SELECT recording_id, n_words, ' ' || regexp_replace(lower(text_raw), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ' AS t FROM segments)
SELECT recording_id, round(1000.0 * sum(len(regexp_extract_all(t, ' (?:يعني|طيب|أه+|امم+|اه+|اللي  هو|بقى|كده|ماشي|okay|ok) '))) / nullif(sum(n_words), 0), 4) AS fillers_per_1000 FROM t GROUP BY recording_id"""),
    Query("gap_reasons", "J04 F09", ["segments"], lambda d: f"""
WITH {_gaps(d)},
r AS (SELECT recording_id, gap_start, gap_end FROM g WHERE gap_end - gap_start >= 1.0),
n AS (SELECT recording_id, end_s - 1.0 AS a, end_s + 1.5 AS b, CASE segment_id % 3 WHEN 0 THEN 'silent' WHEN 1 THEN 'refilled' ELSE 'audible_untranscribed' END AS reason, CASE segment_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS priority FROM {d.segments})
SELECT r.recording_id, round(r.gap_start, 3) AS gap_start, round(r.gap_end, 3) AS gap_end, coalesce(min_by(n.reason, n.priority), 'unknown') AS reason
FROM r LEFT JOIN n ON n.recording_id = r.recording_id AND r.gap_start < n.b AND r.gap_end > n.a GROUP BY r.recording_id, r.gap_start, r.gap_end"""),
    Query("gap_changes", "J05", ["segments", "keyframes"], lambda d: f"""
WITH {_gaps(d)},
r AS (SELECT recording_id, gap_start, gap_end FROM g WHERE gap_end - gap_start >= 1.0)
SELECT r.recording_id, round(gap_start, 3) AS gap_start, count(k.image_id) AS changes FROM r LEFT JOIN {d.keyframes} k ON k.recording_id = r.recording_id AND k.ts >= gap_start AND k.ts < gap_end GROUP BY r.recording_id, gap_start"""),
    Query("gap_levels", "W31", ["segments", "frame_signals"], lambda d: f"""
WITH {_gaps(d)},
r AS (SELECT recording_id, gap_start, gap_end FROM g WHERE gap_end - gap_start >= 1.0)
SELECT r.recording_id, round(gap_start, 3) AS gap_start, round(20.0 * log10(sqrt(avg(f.pixel_diff * f.pixel_diff))), 4) AS level_dbfs, sqrt(avg(f.pixel_diff * f.pixel_diff)) < 0.18 AS silent
FROM r JOIN {d.frame_signals} f ON f.recording_id = r.recording_id AND f.ts >= gap_start AND f.ts < gap_end GROUP BY r.recording_id, gap_start"""),
    Query("quiet_cut", "W31", ["frame_signals"], lambda d: f"""
WITH b AS (SELECT recording_id, floor(ts / 0.5) * 0.5 AS bin, sqrt(avg(pixel_diff * pixel_diff)) AS energy FROM {d.frame_signals} GROUP BY recording_id, floor(ts / 0.5) * 0.5),
t AS (SELECT recording_id, max(ts) AS target FROM {d.frame_signals} GROUP BY recording_id)
SELECT t.recording_id, min_by(bin, round(energy, 9) * 1000000 + bin / 1000000) AS cut_s FROM t JOIN b ON b.recording_id = t.recording_id AND bin >= target - 30 AND bin < target GROUP BY t.recording_id"""),
    Query("caption_stamps", "F08 S11", ["segments"], lambda d: f"""
WITH m AS (SELECT recording_id, segment_id, text_clean, CAST(floor(start_s * 1000 + 0.5) AS BIGINT) AS a, CAST(floor(end_s * 1000 + 0.5) AS BIGINT) AS b FROM {d.segments})
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY a, segment_id) AS cue,
       concat({_stamp('a')}, ' --> ', {_stamp('b')}) AS stamp, text_clean AS text FROM m"""),
    Query("time_display", "F08", ["segments"], lambda d: f"""
SELECT recording_id, segment_id, {_clock('CAST(floor(floor(start_s * 1000 + 0.5) / 1000) AS BIGINT)')} AS display,
       replace({_clock('CAST(floor(floor(start_s * 1000 + 0.5) / 1000) AS BIGINT)')}, ':', '-') AS file_safe FROM {d.segments}"""),
    Query("durations_spoken", "F10 F11", ["job_facts"], lambda d: f"""
SELECT seq, CASE WHEN duration_seconds < 60 THEN concat(CAST(CAST(floor(duration_seconds) AS BIGINT) AS STRING), ' s') WHEN duration_seconds < 3600 THEN concat(CAST(CAST(floor(duration_seconds / 60) AS BIGINT) AS STRING), ' min') ELSE concat(CAST(CAST(floor(duration_seconds / 3600) AS BIGINT) AS STRING), ' h') END AS spoken,
       CASE WHEN elapsed_seconds / nullif(duration_seconds, 0) < 0.03 OR elapsed_seconds < 5 THEN NULL ELSE round(greatest(0.0, duration_seconds - elapsed_seconds), 3) END AS remaining_s FROM {d.job_facts}"""),
    Query("count_agreement", "F10", ["segments"], lambda d: f"""
SELECT recording_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) = 2 THEN 'two' WHEN count(*) % 100 BETWEEN 3 AND 10 THEN 'few' ELSE 'many' END AS form FROM {d.segments} GROUP BY recording_id"""),
    Query("activity_sessions", "X12", ["segments"], lambda d: f"""
WITH f AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY recording_id ORDER BY segment_id) > 2.5 THEN 1 ELSE 0 END AS fresh FROM {d.segments}),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY segment_id) AS session FROM f)
SELECT recording_id, CAST(session AS BIGINT) AS session, count(*) AS segments, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s FROM s GROUP BY recording_id, session"""),
    Query("stream_coverage_batch", "X10", ["segments"], lambda d: f"""
SELECT recording_id, segment_id, round(100.0 * sum(greatest(0.0, end_s - start_s)) OVER (PARTITION BY recording_id ORDER BY segment_id) / nullif(max(end_s) OVER (PARTITION BY recording_id ORDER BY segment_id), 0), 4) AS coverage_percent,
       CAST(sum(n_words) OVER (PARTITION BY recording_id ORDER BY segment_id) AS BIGINT) AS words FROM {d.segments}"""),
]


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def _clock(s: str) -> str:
    return f"concat({_pad(f'CAST(floor({s} / 3600) AS BIGINT)', 2)}, ':', {_pad(f'CAST(floor({s} % 3600 / 60) AS BIGINT)', 2)}, ':', {_pad(f'{s} % 60', 2)})"


def _stamp(ms: str) -> str:
    return f"concat({_clock(f'CAST(floor({ms} / 1000) AS BIGINT)')}, ',', {_pad(f'{ms} % 1000', 3)})"
