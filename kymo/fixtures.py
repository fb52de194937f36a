"""The views that queries run on, derived from the given tables; each for Spark and for the engine that checks it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_BOTH = {
    "segments": """
WITH t AS (SELECT conv_id, turn, text, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS n_words FROM conversations),
d AS (SELECT conv_id, turn, text, n_words, round(greatest(0.5, 0.4 * n_words), 1) AS dur,
             CAST((conv_id * 7 + turn * 13) % 50 AS DOUBLE) / 10.0 AS pause FROM t),
p AS (SELECT *, coalesce(sum(dur + pause) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM d)
SELECT conv_id AS recording_id, turn + 1 AS segment_id, round(off + pause, 1) AS start_s, round(off + pause + dur, 1) AS end_s,
       text AS text_raw, trim(text) AS text_clean, CAST(n_words AS BIGINT) AS n_words FROM p""",
    "keyframes": """
SELECT label AS recording_id, vec_id AS image_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id)) * 7 AS DOUBLE) AS ts,
       d.text AS ocr_text, vec_id % 5 <> 0 AS privacy_scanned, vec_id % 17 = 0 AS redaction_failed, vec_id % 23 = 0 AS sensitive, label % 3 <> 0 AS anonymised, embedding
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id % 200""",
    "job_facts": """
SELECT event_id AS seq, concat('job', CAST(event_id % 300 AS STRING)) AS job_key, ts AS at_ts,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed'
            WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS status,
       round(value * 60, 1) AS duration_seconds, round(value * 30 + event_id % 100, 1) AS elapsed_seconds,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(50 + event_id % 50 AS DOUBLE) END AS quality_score,
       CASE WHEN user_id % 2 = 0 THEN 'engine_a' ELSE 'engine_b' END AS engine,
       CASE WHEN user_id % 3 = 0 THEN 'small' ELSE 'large' END AS model,
       event_id % 2 = 0 AS rewrite, event_id % 5 = 0 AS study, event_id % 3 <> 0 AS source_present,
       CASE event_id % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'transcribe' WHEN 2 THEN 'scenes' ELSE 'document' END AS stage, event_id % 8 AS stage_idx,
       CASE event_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.srt' ELSE '.pdf' END AS output_suffix,
       CASE WHEN event_id % 4 <> 0 THEN concat('pack-', CASE WHEN event_id % 7 <> 0 AND user_id % 3 = 0 THEN 'old' ELSE 'now' END) END AS pack_fingerprint, 'pack-now' AS source_fingerprint FROM events""",
    "wallet_events": """
SELECT user_id AS code, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'settle' WHEN 'error' THEN 'settle' ELSE 'get' END AS op,
       CASE WHEN event_type = 'click' THEN event_id
            WHEN event_type IN ('purchase','error') THEN max(CASE WHEN event_type = 'click' THEN event_id END)
                 OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS hold_id,
       CAST(round(value * 100) AS BIGINT) AS want_units,
       CASE WHEN event_type = 'purchase' THEN CAST(round(value * 80) AS BIGINT) ELSE 0 END AS actual_units FROM events""",
    "screen_events": """
SELECT user_id AS recording_id, event_id AS seq,
       CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id)) * 220 AS BIGINT) AS at_ms,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'up' WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'enter' ELSE 'shortcut' END AS kind,
       value AS sx, CAST((event_id * 31) % 600 AS DOUBLE) AS sy,
       CASE WHEN event_id % 3 = 0 THEN 'textbox' WHEN event_id % 7 = 0 THEN 'checkbox' ELSE 'button' END AS role,
       concat('app', CAST(event_id % 4 AS STRING)) AS app FROM events""",
    "accounts": """
WITH a AS (SELECT c_nationkey AS account, CAST(floor(sum(c_acctbal) / count(*) * 40) AS BIGINT) AS cap FROM customer GROUP BY c_nationkey)
SELECT c_custkey AS code, c_nationkey AS account, cap, cap * 3 AS balance, cap * 2 AS alert_at FROM customer JOIN a ON account = c_nationkey""",
    "licences": """
SELECT user_id AS code, max(CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 1 ELSE 0 END) = 1 AS revoked, min(CASE WHEN event_type = 'signup' THEN ts END) AS activated_at, min(ts) AS first_at, max(ts) AS last_at,
       count(DISTINCT CAST(ts AS DATE)) AS days_used, max(event_id) % 13 <> 0 AS is_activated, max(event_id) % 11 <> 0 AS device_matches, max(event_id) % 7 = 0 AS clock_moved_back, max(event_id) % 5 = 0 AS blocked,
       20 AS term_days, 20 AS days_allowed, 60 AS lease_days, 7 AS recheck_days FROM events GROUP BY user_id""",
    "device_usage": """
SELECT c.c_nationkey AS code, c.c_custkey AS device, count(*) AS jobs_total,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS completed, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS failed,
       round(sum(o_totalprice) / 1000, 1) AS video_minutes, round(avg(o_totalprice) / 4000, 1) AS average_quality, max(o_orderdate) AS reported_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey, c.c_custkey""",
}
SPARK = _BOTH | {
    "timed_segments": """
WITH t AS (SELECT conv_id, turn, text, filter(split(text, ' '), w -> w <> '') AS ws FROM conversations WHERE trim(text) <> ''),
c AS (SELECT *, (conv_id + turn * 3) % 41 AS c, turn % 3 AS k, size(filter(split(text, ' '), w -> w <> '')) AS n FROM t),
d AS (SELECT *, round(0.4 * (n - 1) + 3.0 * floor((n - 1 + c) / 41) + 0.1 * floor((n - 1 + k) / 3) + 0.32, 3) AS dur FROM c),
p AS (SELECT *, coalesce(sum(dur + 0.7) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM d)
SELECT conv_id AS recording_id, turn + 1 AS segment_id, round(off, 3) AS start_s, round(off + dur, 3) AS end_s, text AS text_raw, trim(text) AS text_clean,
       CASE WHEN turn % 13 = 12 THEN NULL ELSE transform(ws, (w, i) -> named_struct('word', w, 'start_s', CAST(round(off + 0.4 * i + 3.0 * floor((i + c) / 41) + 0.1 * floor((i + k) / 3), 3) AS DOUBLE), 'end_s', CAST(round(off + 0.4 * i + 3.0 * floor((i + c) / 41) + 0.1 * floor((i + k) / 3) + 0.32, 3) AS DOUBLE), 'probability', CAST((50 + (length(w) * 7 + i * 13) % 50) / 100.0 AS DOUBLE))) END AS words,
       CASE WHEN turn % 7 <> 6 THEN n / 20.0 END AS compression, CASE WHEN turn % 5 <> 4 THEN -1.0 * (turn % 5) / 2.5 END AS logprob, CASE WHEN turn % 11 <> 0 THEN (turn % 10) / 10.0 END AS no_speech FROM p""",
    "ocr_words": """
SELECT doc_id AS image_id, li AS line, wi AS word_idx, w AS text, CAST(50 + (length(w) * 7 + wi * 13) % 50 AS DOUBLE) AS conf,
       CAST(wi * 90 AS DOUBLE) AS left_px, CAST(li * 20 AS DOUBLE) AS top_px, CAST(length(w) * 8 AS DOUBLE) AS width_px, CAST(14 AS DOUBLE) AS height_px
FROM documents LATERAL VIEW posexplode(split(text, '\n')) a AS li, ln LATERAL VIEW posexplode(split(ln, ' ')) b AS wi, w WHERE w <> ''""",
    "eval_pairs": """
SELECT item_id AS clip, item_id % 4 AS source, text AS reference,
       array_join(filter(split(text, ' '), (w, i) -> (i + item_id) % 7 <> 6), ' ') AS hypothesis, CASE WHEN item_id % 11 = 0 THEN 'excluded' WHEN item_id % 7 = 0 THEN 'unreviewed' ELSE 'scored' END AS review, item_id % 3 AS variant FROM benchmark""",
    "frame_signals": """
WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev,
                  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
SELECT label AS recording_id, round(CAST(rn AS DOUBLE) / 3, 6) AS ts, round(aggregate(zip_with(embedding, prev, (a, b) -> abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE))), 0D, (s, x) -> s + x) / size(embedding), 6) AS pixel_diff
FROM p WHERE prev IS NOT NULL""",
    "plan_blocks": """
SELECT doc_id AS plan_id, CAST(floor(li / 5) AS INT) AS section_idx, li AS block_idx,
       CASE WHEN li % 4 = 3 THEN 'figure' ELSE 'paragraph' END AS kind, ln AS text, CAST(li * 6 AS DOUBLE) AS source_start, CAST(li * 6 + 5 - li % 3 AS DOUBLE) AS source_end,
       li % 7 <> 0 AS heard, li % 5 <> 0 AS cites_speech, li % 3 = 0 AS cites_screen, li % 40 AS cited_segment
FROM documents LATERAL VIEW posexplode(split(text, '\n')) a AS li, ln WHERE trim(ln) <> ''""",
}
DUCK = _BOTH | {
    "timed_segments": """
WITH t AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda w : w <> '') AS ws FROM conversations WHERE trim(text) <> ''),
c AS (SELECT *, (conv_id + turn * 3) % 41 AS c, turn % 3 AS k, len(list_filter(string_split(text, ' '), lambda w : w <> '')) AS n FROM t),
d AS (SELECT *, round(0.4 * (n - 1) + 3.0 * floor((n - 1 + c) / 41) + 0.1 * floor((n - 1 + k) / 3) + 0.32, 3) AS dur FROM c),
p AS (SELECT *, coalesce(sum(dur + 0.7) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM d)
SELECT conv_id AS recording_id, turn + 1 AS segment_id, round(off, 3) AS start_s, round(off + dur, 3) AS end_s, text AS text_raw, trim(text) AS text_clean,
       CASE WHEN turn % 13 = 12 THEN NULL ELSE list_transform(ws, lambda w, i : {'word': w, 'start_s': CAST(round(off + 0.4 * (i - 1) + 3.0 * floor(((i - 1) + c) / 41) + 0.1 * floor(((i - 1) + k) / 3), 3) AS DOUBLE), 'end_s': CAST(round(off + 0.4 * (i - 1) + 3.0 * floor(((i - 1) + c) / 41) + 0.1 * floor(((i - 1) + k) / 3) + 0.32, 3) AS DOUBLE), 'probability': CAST((50 + (length(w) * 7 + (i - 1) * 13) % 50) / 100.0 AS DOUBLE)}) END AS words,
       CASE WHEN turn % 7 <> 6 THEN n / 20.0 END AS compression, CASE WHEN turn % 5 <> 4 THEN -1.0 * (turn % 5) / 2.5 END AS logprob, CASE WHEN turn % 11 <> 0 THEN (turn % 10) / 10.0 END AS no_speech FROM p""",
    "ocr_words": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS li FROM documents),
x AS (SELECT doc_id, li, unnest(string_split(ln, ' ')) AS w, generate_subscripts(string_split(ln, ' '), 1) - 1 AS wi FROM l)
SELECT doc_id AS image_id, li AS line, wi AS word_idx, w AS text, CAST(50 + (length(w) * 7 + wi * 13) % 50 AS DOUBLE) AS conf,
       CAST(wi * 90 AS DOUBLE) AS left_px, CAST(li * 20 AS DOUBLE) AS top_px, CAST(length(w) * 8 AS DOUBLE) AS width_px, CAST(14 AS DOUBLE) AS height_px FROM x WHERE w <> ''""",
    "eval_pairs": """
SELECT item_id AS clip, item_id % 4 AS source, text AS reference,
       array_to_string(list_filter(string_split(text, ' '), lambda w, i : (i - 1 + item_id) % 7 <> 6), ' ') AS hypothesis, CASE WHEN item_id % 11 = 0 THEN 'excluded' WHEN item_id % 7 = 0 THEN 'unreviewed' ELSE 'scored' END AS review, item_id % 3 AS variant FROM benchmark""",
    "frame_signals": """
WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev,
                  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
SELECT label AS recording_id, round(CAST(rn AS DOUBLE) / 3, 6) AS ts, round(list_sum(list_transform(list_zip(embedding, prev), lambda t : abs(CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)))) / len(embedding), 6) AS pixel_diff
FROM p WHERE prev IS NOT NULL""",
    "plan_blocks": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS li FROM documents)
SELECT doc_id AS plan_id, CAST(floor(li / 5) AS INT) AS section_idx, li AS block_idx,
       CASE WHEN li % 4 = 3 THEN 'figure' ELSE 'paragraph' END AS kind, ln AS text, CAST(li * 6 AS DOUBLE) AS source_start, CAST(li * 6 + 5 - li % 3 AS DOUBLE) AS source_end,
       li % 7 <> 0 AS heard, li % 5 <> 0 AS cites_speech, li % 3 = 0 AS cites_screen, li % 40 AS cited_segment FROM l WHERE trim(ln) <> ''""",
}

#: Blocks with the title of their section and, for figures, a caption and the text of the screen.
_TITLED = """
SELECT plan_id, section_idx, block_idx, kind, text, source_start, source_end, first_value(substr(text, 1, 60)) OVER (PARTITION BY plan_id, section_idx ORDER BY block_idx) AS section_title,
       CASE WHEN kind = 'figure' THEN concat(substr(text, 1, 60), ' — 00:0', CAST(block_idx % 10 AS STRING), ':15') END AS caption, CASE WHEN kind = 'figure' THEN text END AS ocr_text FROM ({}) b"""
SPARK["titled_blocks"], DUCK["titled_blocks"] = _TITLED.format(SPARK["plan_blocks"]), _TITLED.format(DUCK["plan_blocks"])


def needed(inputs: list[str]) -> list[str]:
    """Those of the inputs that are views over the given tables."""
    return [name for name in inputs if name in DUCK]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived view, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in TABLES:
        if re.search(rf"(FROM|JOIN) {t}\b", SPARK[name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(SPARK[name])
