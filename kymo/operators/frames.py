"""Frame signals: thresholds, scene intervals, keyframe choice. Frames arrive as arrays or as measured differences."""

from __future__ import annotations

from ..plans.query import Query

# Deviations over the median, the scale of the median absolute deviation, the least threshold.
K, SCALE, FLOOR = 3.0, 1.4826, 0.05


def _threshold(d) -> str:
    return f"""med AS (SELECT recording_id, median(pixel_diff) AS mid, count(*) AS n FROM {d.frame_signals} GROUP BY recording_id),
mad AS (SELECT f.recording_id, median(abs(pixel_diff - mid)) AS mad FROM {d.frame_signals} f JOIN med ON med.recording_id = f.recording_id GROUP BY f.recording_id),
thr AS (SELECT med.recording_id, CASE WHEN n < 4 THEN {FLOOR} ELSE greatest({FLOOR}, mid + {K} * {SCALE} * mad) END AS threshold FROM med JOIN mad ON mad.recording_id = med.recording_id)"""


def _cuts(d) -> str:
    """Cuts by rank: the signals over the median, as scene starts; the end is the next start."""
    return f"""m AS (SELECT recording_id, median(pixel_diff) AS mid, max(ts) AS duration FROM {d.frame_signals} GROUP BY recording_id),
cut AS (SELECT f.recording_id, ts, pixel_diff FROM {d.frame_signals} f JOIN m ON m.recording_id = f.recording_id WHERE pixel_diff >= mid * 1.04),
scene AS (SELECT c.recording_id, row_number() OVER (PARTITION BY c.recording_id ORDER BY ts) AS scene_id, ts AS start_s, coalesce(lead(ts) OVER (PARTITION BY c.recording_id ORDER BY ts), duration) AS end_s, pixel_diff AS score FROM cut c JOIN m ON m.recording_id = c.recording_id)"""


def _sum(d, body: str) -> str:
    return f"aggregate(transform(embedding, v -> {body}), 0D, (s, x) -> s + x)" if d.spark else f"list_sum(list_transform(embedding, lambda v : {body}))"


def _bits(d) -> str:
    """The signs of the first 60 differences of neighbours, as a long."""
    if d.spark:
        return "aggregate(transform(sequence(1, 60), i -> CASE WHEN embedding[i] > embedding[i - 1] THEN shiftleft(1L, i - 1) ELSE 0L END), 0L, (s, x) -> s + x)"
    return "CAST(list_sum(list_transform(range(1, 61), lambda i : CASE WHEN embedding[i + 1] > embedding[i] THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT)"


QUERIES = [
    Query("adaptive_threshold", "T03", ["frame_signals"], lambda d: f"WITH {_threshold(d)} SELECT recording_id, round(threshold, 6) AS threshold FROM thr"),
    Query("scene_intervals", "W17", ["frame_signals"], lambda d: f"""
WITH {_cuts(d)} SELECT recording_id, scene_id, start_s, end_s, round(CASE WHEN end_s - start_s > 0.2 THEN least(start_s + 0.35 * (end_s - start_s), end_s - 0.05) ELSE (start_s + end_s) / 2.0 END, 6) AS representative_s FROM scene WHERE end_s > start_s"""),
    Query("candidate_times", "W18", ["frame_signals"], lambda d: f"""
WITH {_cuts(d)} SELECT recording_id, scene_id, k, round(CASE WHEN end_s - start_s < 0.6 THEN (start_s + end_s) / 2.0 ELSE start_s + (end_s - start_s) * (0.45 + 0.47 * k / 3.0) END, 4) AS at_s FROM scene CROSS JOIN {d.values('v', 'k', '(0), (1), (2), (3)')} WHERE end_s > start_s AND (k = 0 OR end_s - start_s >= 0.6)"""),
    Query("best_candidates", "W19", ["frame_signals"], lambda d: f"""
WITH {_cuts(d)}, c AS (SELECT s.recording_id, scene_id, f.ts, f.pixel_diff - least(8.0, 0.01 * abs(f.ts - start_s)) AS score FROM scene s JOIN {d.frame_signals} f ON f.recording_id = s.recording_id AND f.ts >= start_s AND f.ts < end_s)
SELECT recording_id, scene_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, scene_id ORDER BY score DESC, ts) AS rn FROM c) x WHERE rn = 1"""),
    Query("strongest_scenes", "T02", ["frame_signals"], lambda d: f"""
WITH {_cuts(d)} SELECT recording_id, scene_id, start_s FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, start_s) AS rn FROM scene) x WHERE rn <= 8"""),
    Query("weak_frames_dropped", "W21", ["frame_signals"], lambda d: f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY pixel_diff) AS rn, count(*) OVER (PARTITION BY recording_id) AS n, max(pixel_diff) OVER (PARTITION BY recording_id) AS best FROM {d.frame_signals}),
u AS (SELECT recording_id, max(CASE WHEN rn = CAST(floor(n / 2) AS BIGINT) + 1 THEN pixel_diff END) AS upper_median FROM r GROUP BY recording_id)
SELECT r.recording_id, r.ts FROM r JOIN u ON u.recording_id = r.recording_id WHERE n < 4 OR pixel_diff >= 0.95 * upper_median OR pixel_diff = best"""),
    Query("rejected_frames", "P11", ["embeddings"], lambda d: f"""
SELECT vec_id AS image_id, round({_sum(d, 'CAST(v AS DOUBLE)')} / {d.size('embedding')}, 6) AS brightness, round({_sum(d, 'CASE WHEN v > 0 THEN 1.0D ELSE 0.0D END' if d.spark else 'CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END')} / {d.size('embedding')}, 6) < 0.4 AS blank FROM {d.embeddings}"""),
    Query("frame_quality", "F18", ["embeddings"], lambda d: f"""
SELECT vec_id AS image_id, round(sqrt({_sum(d, 'CAST(v AS DOUBLE) * CAST(v AS DOUBLE)')}), 5) AS energy, {_bits(d)} AS difference_hash FROM {d.embeddings}"""),
    Query("hash_similarity", "F18", ["embeddings"], lambda d: f"""
WITH h AS (SELECT label, vec_id, {_bits(d)} AS bits FROM {d.embeddings}), n AS (SELECT label, vec_id, bits, lag(bits) OVER (PARTITION BY label ORDER BY vec_id) AS before_bits FROM h)
SELECT label AS recording_id, vec_id AS image_id, bit_count({'bits ^ before_bits' if d.spark else 'xor(bits, before_bits)'}) AS differing FROM n WHERE before_bits IS NOT NULL"""),
]
