"""Recognition accuracy and study evaluation, and the guides made from screen steps."""

from __future__ import annotations

from ..plans.query import Query




def _errors(d) -> str:
    """Word and character errors of each pair. Words become private code points of their place among the pair's words."""
    norm = lambda x: f"trim({d.replace(d.replace(f'lower({x})', '[^a-zà-ÿ0-9 ]+', ' '), ' +', ' ')})"
    if d.spark:
        code = "array_join(transform({x}, w -> decode(unhex(lpad(hex(19968 + array_position(ws, w)), 4, '0')), 'UTF-16BE')), '')"
        ws, edit = "array_distinct(concat(r, h))", "levenshtein"
    else:
        code = "array_to_string(list_transform({x}, lambda w : chr(CAST(33 + list_position(ws, w) AS INTEGER))), '')"  # that engine's distance is over bytes
        ws, edit = "list_distinct(list_concat(r, h))", "levenshtein"
    plain = lambda x: f"replace({x}, ' ', '')" if d.spark else f"translate(replace({x}, ' ', ''), 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_{{}}')"
    return f"""n AS (SELECT clip, source, {norm('reference')} AS ref, {norm('hypothesis')} AS hyp FROM {d.eval_pairs}),
s AS (SELECT clip, source, ref, hyp, {d.split('ref')} AS r, {d.split('hyp')} AS h FROM n),
c AS (SELECT *, {ws} AS ws FROM s),
e AS (SELECT clip, source, {edit}({code.format(x='r')}, {code.format(x='h')}) AS word_errors, CAST({d.size('r')} AS BIGINT) AS words, {edit}({plain('ref')}, {plain('hyp')}) AS char_errors, CAST(length(replace(ref, ' ', '')) AS BIGINT) AS chars, ref = hyp AS untouched, hyp = '' AS empty FROM c)"""


def _plan(d) -> str:
    """Clips per source: a capacity of one a minute, one at least, the rest by largest remainder. Sources are few: they are ranked together."""
    return f"""dur AS (SELECT user_id % 100 AS source, sum(value) AS seconds FROM {d.events} GROUP BY user_id % 100),
cap AS (SELECT source, seconds, greatest(1, CAST(floor(seconds / 60) AS BIGINT)) AS capacity, sum(seconds) OVER () AS total, count(*) OVER () AS sources FROM dur),
quota AS (SELECT *, 1 + (2.0 * sources) * seconds / total AS share FROM cap),
base AS (SELECT *, CAST(floor(share) AS BIGINT) AS whole, share - floor(share) AS fraction FROM quota),
rest AS (SELECT *, 3 * sources - sum(whole) OVER () AS leftover, row_number() OVER (ORDER BY round(fraction, 9) DESC, source) AS place FROM base),
clips AS (SELECT source, least(capacity, whole + CASE WHEN place <= leftover THEN 1 ELSE 0 END) AS clips, seconds FROM rest)"""


_STEPS = """st AS (SELECT recording_id, seq, at_ms, kind, role, app, concat(app, '/', role) AS screen, lead(concat(app, '/', role)) OVER (PARTITION BY recording_id ORDER BY seq) AS next_screen FROM {screen_events})"""


def _steps(d) -> str:
    return _STEPS.format(screen_events=d.screen_events)


QUERIES = [
    Query("word_errors", "E01 E02 F05", ["eval_pairs"], lambda d: f"WITH {_errors(d)} SELECT clip, source, CAST(word_errors AS BIGINT) AS word_errors, words, CAST(char_errors AS BIGINT) AS char_errors, chars FROM e"),
    Query("pooled_accuracy", "E01 E02", ["eval_pairs"], lambda d: f"""
WITH {_errors(d)} SELECT source, round(100.0 * (1 - CAST(sum(word_errors) AS DOUBLE) / nullif(sum(words), 0)), 4) AS word_accuracy, round(100.0 * (1 - CAST(sum(char_errors) AS DOUBLE) / nullif(sum(chars), 0)), 4) AS char_accuracy, count(*) AS clips FROM e GROUP BY source"""),
    Query("engine_benchmark", "E03", ["eval_pairs", "job_facts"], lambda d: f"""
WITH {_errors(d)},
a AS (SELECT CASE WHEN source % 2 = 0 THEN 'engine_a' ELSE 'engine_b' END AS engine, 100.0 * (1 - CAST(sum(word_errors) AS DOUBLE) / sum(words)) AS accuracy FROM e GROUP BY 1),
t AS (SELECT engine, sum(elapsed_seconds) / sum(duration_seconds) AS realtime FROM {d.job_facts} WHERE duration_seconds > 0 GROUP BY engine)
SELECT a.engine, round(accuracy, 4) AS accuracy, round(realtime, 6) AS realtime_factor, accuracy = max(accuracy) OVER () AS most_accurate, realtime = min(realtime) OVER () AS fastest FROM a JOIN t ON t.engine = a.engine"""),
    Query("evaluation_report", "E07 J21", ["eval_pairs"], lambda d: f"""
WITH {_errors(d)}, k AS (SELECT e.*, p.review FROM e JOIN {d.eval_pairs} p ON p.clip = e.clip)
SELECT source, review, count(*) AS clips, count(CASE WHEN untouched THEN 1 END) AS untouched, count(CASE WHEN empty THEN 1 END) AS empty, round(CAST(sum(word_errors) AS DOUBLE) / nullif(sum(words), 0), 6) AS wer, sum(words) < 800 AS few_words FROM k GROUP BY source, review"""),
    Query("variant_deltas", "E08", ["eval_pairs"], lambda d: f"""
WITH {_errors(d)}, v AS (SELECT p.variant, 100.0 * (1 - CAST(sum(word_errors) AS DOUBLE) / sum(words)) AS accuracy FROM e JOIN {d.eval_pairs} p ON p.clip = e.clip GROUP BY p.variant)
SELECT v.variant, round(v.accuracy, 4) AS accuracy, round(v.accuracy - b.accuracy, 4) AS delta FROM v CROSS JOIN (SELECT accuracy FROM v WHERE variant = 0) b"""),
    Query("worst_clips", "T09", ["eval_pairs"], lambda d: f"WITH {_errors(d)} SELECT clip, round(CAST(word_errors AS DOUBLE) / words, 6) AS wer FROM e ORDER BY CAST(word_errors AS DOUBLE) / words DESC, clip LIMIT 5"),
    Query("clip_plan", "E05", ["events"], lambda d: f"WITH {_plan(d)} SELECT source, clips, round(seconds, 2) AS seconds FROM clips"),
    Query("speech_draws", "E06", ["segments"], lambda d: f"""
WITH t AS (SELECT recording_id, max(end_s) AS duration, sum(end_s - start_s) / max(end_s) AS ratio FROM {d.segments} GROUP BY recording_id),
draw AS (SELECT recording_id, k, (recording_id * 37 + k * 61) % 100 / 100.0 AS at_share, ratio FROM t CROSS JOIN {d.values('v', 'k', '(0), (1), (2), (3), (4)')}),
sc AS (SELECT *, (ratio + at_share) / 2 AS speech FROM draw),
pick AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN speech >= 0.5 THEN k ELSE 100 END, round(speech, 9) DESC, k) AS rn FROM sc)
SELECT recording_id, k AS draw, round(speech, 6) AS speech, speech < 0.5 AS weak FROM pick WHERE rn = 1"""),
    Query("settings_sweep", "E10", ["segments"], lambda d: f"""
WITH v AS (SELECT recording_id % 4 AS variant, recording_id, max(end_s) AS duration, sum(end_s - start_s) AS spoken, sum(n_words) AS words FROM {d.segments} GROUP BY recording_id % 4, recording_id)
SELECT variant, round(100.0 * sum(spoken) / sum(duration), 4) AS coverage, round(60.0 * sum(words) / sum(duration), 4) AS words_per_minute, count(*) AS recordings FROM v GROUP BY variant"""),
    Query("acceptance_rate", "E11", ["plan_blocks"], lambda d: f"""
WITH g AS (SELECT plan_id, 'has_sections' AS gate, count(DISTINCT section_idx) > 0 AS passed FROM {d.plan_blocks} GROUP BY plan_id UNION ALL SELECT plan_id, 'has_figures', count(CASE WHEN kind = 'figure' THEN 1 END) > 0 FROM {d.plan_blocks} GROUP BY plan_id
UNION ALL SELECT plan_id, 'times_ordered', bool_and(source_end >= source_start) FROM {d.plan_blocks} GROUP BY plan_id)
SELECT gate, count(*) AS checked, count(CASE WHEN passed THEN 1 END) AS passed, 100.0 * count(CASE WHEN passed THEN 1 END) / count(*) >= 97 AS accepted FROM g GROUP BY gate"""),
    Query("grouped_steps", "W23", ["screen_events"], lambda d: f"""
WITH a AS (SELECT recording_id, seq, CASE WHEN seq % 4 <> 1 THEN app END AS app FROM {d.screen_events}),
f AS (SELECT *, coalesce(last_value(app {'' if d.spark else 'IGNORE NULLS'}{', true' if d.spark else ''}) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(app {'' if d.spark else 'IGNORE NULLS'}{', true' if d.spark else ''}) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS system FROM a),
c AS (SELECT *, CASE WHEN system = lag(system) OVER (PARTITION BY recording_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY seq) AS grp FROM c)
SELECT recording_id, CAST(grp AS BIGINT) AS step_group, min(system) AS system, count(*) AS steps FROM g GROUP BY recording_id, grp"""),
    Query("step_outcomes", "W24 F23", ["screen_events"], lambda d: f"WITH {_steps(d)} SELECT recording_id, seq, CASE WHEN next_screen IS NULL THEN 'finished' WHEN next_screen <> screen THEN next_screen END AS arrived_at FROM st"),
    Query("programs_named", "W25", ["screen_events"], lambda d: f"WITH {_steps(d)} SELECT recording_id, seq, CASE WHEN app = lag(app) OVER (PARTITION BY recording_id ORDER BY seq) THEN NULL ELSE app END AS named_app FROM st"),
    Query("step_sentences", "P25", ["screen_events"], lambda d: f"""
WITH v AS (SELECT * FROM {d.values('v', 'kind, role, sentence', "('click', 'button', 'Press the button in'), ('click', 'checkbox', 'Tick the box in'), ('click', 'textbox', 'Click the field in'), ('type', 'textbox', 'Type into the field in'), ('enter', 'textbox', 'Press Enter in')")})
SELECT e.recording_id, e.seq, concat(coalesce(v.sentence, 'Go on in'), ' ', e.app, '.') AS sentence FROM {d.screen_events} e LEFT JOIN v ON v.kind = e.kind AND v.role = e.role"""),
    Query("edited_steps", "J18", ["screen_events"], lambda d: f"""
WITH ed AS (SELECT recording_id, seq, seq % 9 = 0 AS deleted, CASE WHEN seq % 7 = 0 THEN concat('edited ', {d.text('seq')}) END AS text FROM {d.screen_events} WHERE seq % 3 = 0)
SELECT e.recording_id, e.seq, row_number() OVER (PARTITION BY e.recording_id ORDER BY e.seq) AS step, coalesce(ed.text, e.kind) AS text FROM {d.screen_events} e LEFT JOIN ed ON ed.recording_id = e.recording_id AND ed.seq = e.seq WHERE NOT coalesce(ed.deleted, false)"""),
]
