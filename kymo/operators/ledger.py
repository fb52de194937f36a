"""Job, audit, usage and metering ledgers."""

from __future__ import annotations

from ..plans.query import Query

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY seq DESC) AS rn FROM {facts}) x WHERE rn = 1)"

_COST = "0.000003"


def _latest(d) -> str:
    return _LATEST.format(facts=d.job_facts)


def _failed_files(d) -> str:
    """A row for each failed job with its batch's counts, and one for each batch without any: no string grows with the failures."""
    return f"""
WITH n AS (SELECT model AS batch, count(*) AS files, count(CASE WHEN status = 'completed' THEN 1 END) AS ok, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM {d.job_facts} GROUP BY model)
SELECT n.*, j.seq, j.job_key AS first_errors FROM {d.job_facts} j JOIN n ON n.batch <=> j.model WHERE j.status = 'failed'
UNION ALL SELECT n.*, NULL, NULL FROM n WHERE failed = 0"""


def _package_id(d) -> str:
    """A tree of digests by the begin of each path's digest: files, then 16**5 branches, then 16**2, then the package. No string holds a whole package."""
    digest = lambda x: f"sha1({x})"
    return f"""
WITH f AS (SELECT source AS package, {d.text('doc_id')} AS path, sha1({'CAST(text AS BINARY)' if d.spark else 'encode(text)'}) AS digest FROM {d.documents}),
h AS (SELECT package, path, substr(sha1(path), 1, 5) AS branch, concat(path, ':', digest) AS line FROM f),
b AS (SELECT package, branch, {digest(d.join('line', ';', 'path, line'))} AS digest FROM h GROUP BY package, branch),
m AS (SELECT package, substr(branch, 1, 2) AS branch, {digest(d.join("concat(branch, ':', digest)", ';', 'branch'))} AS digest FROM b GROUP BY package, substr(branch, 1, 2)),
r AS (SELECT package, {digest(d.join("concat(branch, ':', digest)", ';', 'branch'))} AS digest FROM m GROUP BY package)
SELECT package, substr(sha1(concat(package, ':', digest)), 1, 12) AS package_id FROM r"""


QUERIES = [
    Query("usage_stats", "A01 A02", ["job_facts"], lambda d: f"""
WITH {_latest(d)}
SELECT count(*) AS jobs, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'cancelled' THEN 1 END) AS cancelled,
       count(CASE WHEN status = 'running' THEN 1 END) AS active, round(sum(CASE WHEN status = 'completed' THEN duration_seconds END), 2) AS video_seconds,
       round(sum(CASE WHEN status = 'completed' AND duration_seconds > 0 AND elapsed_seconds > 0 THEN elapsed_seconds END), 2) AS processing_seconds,
       round(100.0 * count(CASE WHEN status = 'completed' THEN 1 END) / nullif(count(CASE WHEN status IN ('completed', 'failed') THEN 1 END), 0), 4) AS success_percent,
       round(avg(CASE WHEN status = 'completed' THEN quality_score END), 4) AS average_quality FROM latest"""),
    Query("latest_facts", "A02", ["job_facts"], lambda d: f"WITH {_latest(d)} SELECT job_key, seq, status, round(duration_seconds, 1) AS duration_seconds FROM latest"),
    Query("monthly_activity", "A03", ["job_facts"], lambda d: f"""
WITH {_latest(d)},
n AS (SELECT date_trunc('month', max(at_ts)) AS now FROM {d.job_facts}),
s AS (SELECT {d.months('CAST(now AS DATE)', '-k')} AS month FROM n CROSS JOIN {d.values('v', 'k', '(0), (1), (2), (3), (4), (5)')}),
a AS (SELECT CAST(date_trunc('month', at_ts) AS DATE) AS month, count(*) AS jobs, sum(duration_seconds) AS seconds FROM latest WHERE status = 'completed' GROUP BY 1)
SELECT {d.text('s.month')} AS month, coalesce(jobs, 0) AS jobs, round(coalesce(seconds, 0.0), 2) AS seconds FROM s LEFT JOIN a ON a.month = s.month"""),
    Query("feature_counts", "A04", ["job_facts"], lambda d: f"""
WITH {_latest(d)}
SELECT 'rewrite' AS feature, count(CASE WHEN rewrite THEN 1 END) AS jobs FROM latest WHERE status = 'completed'
UNION ALL SELECT 'study', count(CASE WHEN study THEN 1 END) FROM latest WHERE status = 'completed'"""),
    Query("format_counts", "A04", ["job_facts"], lambda d: f"""
WITH {_latest(d)},
o AS (SELECT {d.split("CASE seq % 3 WHEN 0 THEN 'docx,pdf' WHEN 1 THEN 'docx,srt' ELSE 'docx' END", ',')} AS outputs FROM latest WHERE status = 'completed')
SELECT format, count(*) AS jobs FROM {d.unnest('o', 'outputs', 'format', 'i')} x GROUP BY format"""),
    Query("course_report", "A05", ["job_facts"], lambda d: f"""
WITH {_latest(d)}
SELECT engine AS course, count(*) AS lectures, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, round(sum(duration_seconds), 2) AS total_seconds, CAST(sum(seq % 7) AS BIGINT) AS questions,
       round(avg(quality_score), 4) AS average_quality, count(DISTINCT CASE WHEN NOT study THEN job_key END) AS needs_study, count(DISTINCT CASE WHEN NOT rewrite THEN job_key END) AS needs_rewrite FROM latest GROUP BY engine"""),
    Query("device_rollup", "A20", ["device_usage"], lambda d: f"""
SELECT code, count(*) AS devices, CAST(sum(jobs_total) AS BIGINT) AS jobs, CAST(sum(completed) AS BIGINT) AS completed, round(sum(average_quality * completed) / nullif(sum(completed), 0), 4) AS quality,
       {d.text('max(reported_at)')} AS last_day, CAST(max_by(device, struct_key) AS BIGINT) AS latest_device FROM (SELECT *, {d.text('reported_at')} || lpad({d.text('device')}, 12, '0') AS struct_key FROM {d.device_usage}) u GROUP BY code"""),
    Query("usage_totals", "A21", ["device_usage"], lambda d: f"""
WITH n AS (SELECT max(reported_at) AS now FROM {d.device_usage}),
c AS (SELECT code, sum(jobs_total) AS jobs, max(CASE WHEN {d.days('now', 'reported_at')} <= 30 AND jobs_total > 0 THEN 1 ELSE 0 END) AS active, sum(completed) AS completed, sum(average_quality * completed) AS weighted, sum(video_minutes) AS minutes FROM {d.device_usage} CROSS JOIN n GROUP BY code)
SELECT count(*) AS users, CAST(sum(active) AS BIGINT) AS active_30, CAST(sum(jobs) AS BIGINT) AS jobs, floor(sum(minutes) * 10 + 0.5) / 10 AS minutes, round(sum(weighted) / nullif(sum(completed), 0), 4) AS quality FROM c"""),
    Query("billing_totals", "A22 F26", ["wallet_events"], lambda d: f"""
WITH u AS (SELECT code, sum(CASE WHEN op = 'settle' THEN actual_units + 5 * (want_units % 7) END) AS units, sum(CASE WHEN op = 'add' THEN want_units END) AS bought FROM {d.wallet_events} GROUP BY code)
SELECT CAST(sum(units) AS BIGINT) AS units, CAST(floor(sum(units) / 600.0 + 0.5) AS BIGINT) AS minutes, round(sum(units) * {_COST}, 6) AS cost_usd, round(sum(units) * {_COST} * 3.75, 6) AS cost_sar, CAST(sum(CASE WHEN bought IS NOT NULL THEN bought - coalesce(units, 0) END) AS BIGINT) AS remaining FROM u"""),
    Query("egress_summary", "A23 P27", ["events"], lambda d: f"""
WITH a AS (SELECT user_id AS job_id, event_id AS seq, concat('prov', {d.text('event_id % 4')}) AS provider, event_type <> 'error' AS sent, event_id % 3 AS images FROM {d.events}),
f AS (SELECT job_id, provider, min(seq) AS first_seq FROM a WHERE sent GROUP BY job_id, provider),
p AS (SELECT job_id, {d.join('provider', ',', 'first_seq')} AS providers FROM f GROUP BY job_id)
SELECT a.job_id, bool_or(sent) AS left_device, max(coalesce(p.providers, '')) AS providers, CAST(sum(CASE WHEN sent THEN images ELSE 0 END) AS BIGINT) AS images_sent, count(CASE WHEN NOT sent THEN 1 END) AS attempted_only
FROM a LEFT JOIN p ON p.job_id = a.job_id GROUP BY a.job_id"""),
    Query("stage_times", "A24", ["job_facts"], lambda d: f"""
WITH s AS (SELECT job_key, stage, elapsed_seconds FROM {d.job_facts})
SELECT stage, count(*) AS jobs, round(sum(elapsed_seconds), 2) AS seconds, round(100.0 * sum(elapsed_seconds) / sum(sum(elapsed_seconds)) OVER (), 4) AS percent FROM s GROUP BY stage"""),
    Query("license_merge", "A26", ["events"], lambda d: f"""
WITH r AS (SELECT user_id AS code, event_id AS issued, CAST(ts AS DATE) AS day, ts FROM {d.events}),
u AS (SELECT DISTINCT code, {d.text('day')} AS day FROM r),
days AS (SELECT code, {d.join('day', ',', 'day')} AS usage_days FROM u GROUP BY code)
SELECT r.code, max(issued) AS newest, {d.seconds('max(ts)')} AS last_seen, max(usage_days) AS usage_days FROM r JOIN days ON days.code = r.code GROUP BY r.code"""),
    Query("package_id", "A27 F14", ["documents"], _package_id),
    Query("token_estimate", "A31", ["conversations"], lambda d: f"SELECT conv_id AS request, CAST(sum(ceil(length(text) / 2.0)) + 1600 * count(CASE WHEN turn % 3 = 0 THEN 1 END) + 5 * 1000 AS BIGINT) AS units FROM {d.conversations} GROUP BY conv_id"),
    Query("batch_summary", "A33", ["job_facts"], _failed_files, sql="""
SELECT f.model AS batch, g.files, g.ok, g.failed, f.seq, f.job_key AS first_errors FROM job_facts f
JOIN (SELECT model, count(*) AS files, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed FROM job_facts GROUP BY model) g ON g.model IS NOT DISTINCT FROM f.model
WHERE f.status = 'failed'
UNION ALL SELECT model, count(*), count(*) FILTER (WHERE status = 'completed'), 0, NULL, NULL FROM job_facts GROUP BY model HAVING count(*) FILTER (WHERE status = 'failed') = 0"""),
    Query("backfilled_facts", "J01", ["job_facts"], lambda d: f"""
WITH led AS (SELECT * FROM {d.job_facts} WHERE seq % 2 = 0), scan AS (SELECT job_key, max(seq) AS seq FROM {d.job_facts} WHERE seq % 2 = 1 GROUP BY job_key),
latest AS (SELECT job_key, max(seq) AS seq FROM led GROUP BY job_key)
SELECT job_key, seq, 'ledger' AS origin FROM latest UNION ALL SELECT job_key, seq, 'scan' FROM scan WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.job_key = scan.job_key)"""),
    Query("licence_usage", "J20", ["device_usage", "customer"], lambda d: f"""
SELECT c.c_custkey AS device, c.c_nationkey AS code, coalesce(u.jobs_total, c.c_custkey % 5) AS jobs_total, u.device IS NOT NULL AS reported FROM {d.customer} c LEFT JOIN {d.device_usage} u ON u.device = c.c_custkey AND u.code = c.c_nationkey"""),
    Query("missing_outputs", "J22", ["job_facts"], lambda d: f"""
WITH {_latest(d)},
present AS (SELECT job_key, output_suffix AS suffix FROM {d.job_facts}),
expected AS (SELECT job_key, suffix FROM latest CROSS JOIN {d.values('e', 'suffix', "('.docx'), ('.srt'), ('.pdf'), ('.study.json')")} WHERE status = 'completed')
SELECT job_key, suffix, CASE suffix WHEN '.study.json' THEN 'study' WHEN '.srt' THEN 'subtitles' ELSE 'document' END AS remedy FROM expected e WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.job_key = e.job_key AND p.suffix = e.suffix)"""),
    Query("clean_usage", "P17", ["device_usage"], lambda d: f"""
SELECT code, device, least(10000000, greatest(0, coalesce(jobs_total, 0))) AS jobs_total, floor(least(10000000.0, greatest(0.0, coalesce(video_minutes, 0.0))) * 10 + 0.5) / 10 AS video_minutes,
       CASE WHEN average_quality IS NULL THEN NULL ELSE floor(least(100.0, greatest(0.0, average_quality)) * 10 + 0.5) / 10 END AS quality, {d.matches(d.text('reported_at'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')} AS day_ok FROM {d.device_usage}"""),
    Query("identifier_checks", "P18", ["customer"], lambda d: f"""
SELECT c_custkey, {d.matches('c_name', '^Customer#[0-9]{9}$')} AS code_ok, {d.matches(d.text('c_custkey'), '^[0-9]{1,12}$')} AS device_ok, {d.matches("concat('1.', " + d.text('c_nationkey') + ", '.0')", '^[0-9]+[.][0-9]+[.][0-9]+$')} AS version_ok FROM {d.customer}"""),
    Query("license_status", "P19", ["licences"], lambda d: f"""
WITH n AS (SELECT max(last_at) AS now FROM {d.licences})
SELECT code, CASE WHEN revoked THEN 'revoked' WHEN activated_at IS NULL THEN 'not_activated' WHEN {d.seconds('now')} - {d.seconds('activated_at')} > term_days * 86400 THEN 'expired' ELSE 'active' END AS status FROM {d.licences} CROSS JOIN n"""),
    Query("lease_verdict", "P20", ["licences"], lambda d: f"""
WITH n AS (SELECT max({d.seconds('last_at')}) AS now FROM {d.licences})
SELECT code, CASE WHEN NOT is_activated THEN 'needs_activation' WHEN NOT device_matches THEN 'device_mismatch' WHEN clock_moved_back THEN 'clock_tampered' WHEN days_used > days_allowed THEN 'expired_days'
            WHEN now - {d.seconds('first_at')} > lease_days * 86400 THEN 'expired_date' WHEN now - {d.seconds('last_at')} > recheck_days * 86400 THEN 'needs_recheck' WHEN blocked THEN 'blocked' ELSE 'active' END AS verdict FROM {d.licences} CROSS JOIN n"""),
    Query("applied_policy", "P21", ["job_facts"], lambda d: f"""
WITH p AS (SELECT * FROM {d.values('p', 'engine, images, provider', "('engine_a', 'yes', 'local'), ('engine_b', 'maybe', '')")})
SELECT seq, CASE WHEN lower(images) IN ('yes', 'true', '1', 'on') THEN true ELSE false END AS images_allowed, coalesce(nullif(provider, ''), model) AS provider FROM {d.job_facts} j JOIN p ON p.engine = j.engine"""),
    Query("applied_profile", "P22", ["job_facts"], lambda d: f"""
WITH p AS (SELECT * FROM {d.values('p', 'profile, min_gap, max_scenes', "('slides', 4.0, NULL), ('screencast', NULL, 120), ('whiteboard', 8.0, 40), ('talking_head', NULL, NULL)")})
SELECT seq, coalesce(p.min_gap, 2.0) AS min_gap, coalesce(p.max_scenes, 80) AS max_scenes FROM {d.job_facts} j LEFT JOIN p ON p.profile = CASE j.seq % 5 WHEN 0 THEN 'slides' WHEN 1 THEN 'screencast' WHEN 2 THEN 'whiteboard' WHEN 3 THEN 'talking_head' END"""),
    Query("inferred_elapsed", "P29", ["job_facts"], lambda d: f"""
WITH s AS (SELECT job_key, {d.seconds('max(at_ts)')} - {d.seconds('min(at_ts)')} AS s, count(*) AS n FROM {d.job_facts} GROUP BY job_key)
SELECT job_key, CASE WHEN s > 0 AND s <= 8 * 3600 AND n < 60 THEN s END AS elapsed_s FROM s"""),
    Query("pack_reuse", "P30", ["job_facts"], lambda d: f"""
SELECT seq, CASE WHEN pack_fingerprint IS NULL THEN 'no_fingerprint' WHEN pack_fingerprint <> source_fingerprint THEN 'fingerprint_changed' WHEN status = 'failed' THEN 'failures' WHEN duration_seconds = 0 THEN 'empty' ELSE 'reusable' END AS verdict FROM {d.job_facts}"""),
    Query("job_actions", "P31", ["job_facts"], lambda d: f"""
WITH {_latest(d)} SELECT job_key, status <> 'completed' AND source_present AS resumable, quality_score IS NOT NULL AS rebuildable FROM latest"""),
    Query("valid_stages", "W28", ["job_facts"], lambda d: f"""
WITH s AS (SELECT job_key, stage_idx AS idx, max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS broken FROM {d.job_facts} GROUP BY job_key, stage_idx),
b AS (SELECT *, min(CASE WHEN broken = 1 THEN idx END) OVER (PARTITION BY job_key) AS first_broken FROM s)
SELECT job_key, idx FROM b WHERE first_broken IS NULL OR idx < first_broken"""),
    Query("quality_trend", "W29", ["job_facts"], lambda d: f"""
SELECT engine, seq, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY at_ts DESC, seq DESC) AS rn FROM {d.job_facts} WHERE quality_score IS NOT NULL AND status = 'completed') x WHERE rn <= 12"""),
    Query("processing_ratio", "W30", ["job_facts"], lambda d: f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY engine, model ORDER BY at_ts DESC, seq DESC) AS rn FROM {d.job_facts} WHERE status = 'completed' AND duration_seconds >= 120)
SELECT engine, model, round(median(elapsed_seconds / duration_seconds), 6) AS ratio FROM c WHERE rn <= 8 GROUP BY engine, model"""),
    Query("open_holds", "W33", ["wallet_events"], lambda d: f"""
WITH e AS (SELECT code, seq, CASE op WHEN 'reserve' THEN 1 WHEN 'settle' THEN -1 ELSE 0 END AS delta FROM {d.wallet_events})
SELECT code, seq, CAST(sum(delta) OVER (PARTITION BY code ORDER BY seq) AS BIGINT) AS open_holds, sum(delta) OVER (PARTITION BY code ORDER BY seq) > 3 AS over_limit FROM e"""),
    Query("job_listing", "T01", ["job_facts"], lambda d: f"""
WITH {_latest(d)} SELECT engine, job_key, row_number() OVER (PARTITION BY engine ORDER BY at_ts DESC, job_key) AS newest_first, row_number() OVER (PARTITION BY engine ORDER BY coalesce(at_ts, TIMESTAMP '1970-01-01 00:00:00'), job_key) AS course_order FROM latest"""),
    Query("recent_jobs", "T04", ["job_facts"], lambda d: f"SELECT seq, job_key, status FROM {d.job_facts} ORDER BY at_ts DESC, seq DESC LIMIT 5"),
    Query("call_log_tail", "T05", ["wallet_events"], lambda d: f"SELECT code, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq DESC) AS rn FROM {d.wallet_events}) x WHERE rn <= 150"),
    Query("pending_files", "U05 F15", ["documents", "job_facts"], lambda d: f"""
WITH inbox AS (SELECT doc_id, concat(source, '/', {d.text('doc_id')}) AS name, n_chars AS size FROM {d.documents}), done AS (SELECT DISTINCT seq % 1000 AS doc_id FROM {d.job_facts} WHERE seq % 3 = 0)
SELECT name, size FROM inbox WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.doc_id = inbox.doc_id)"""),
    Query("job_keys", "F14", ["documents"], lambda d: f"SELECT doc_id, substr(sha1({'CAST(lower(source) AS BINARY)' if d.spark else 'lower(source)'}), 1, 16) AS job_key, substr({'sha2(concat(lang, n_chars), 256)' if d.spark else 'sha256(concat(lang, n_chars))'}, 1, 20) AS fingerprint FROM {d.documents}"),
    Query("usage_windows", "X13", ["job_facts"], lambda d: f"SELECT {d.text('CAST(at_ts AS DATE)')} AS day, count(*) AS jobs, round(sum(duration_seconds), 2) AS seconds FROM {d.job_facts} GROUP BY CAST(at_ts AS DATE)"),
    Query("job_status", "X08", ["job_facts"], lambda d: f"""
WITH f AS (SELECT job_key, max_by(status, seq) AS last_status, count(CASE WHEN status = 'failed' THEN 1 END) AS failures, count(CASE WHEN status = 'completed' THEN 1 END) AS done FROM {d.job_facts} GROUP BY job_key)
SELECT job_key, CASE WHEN last_status = 'failed' AND failures <= 3 THEN 'recoverable' ELSE last_status END AS status, least(100, done * 10) AS progress FROM f"""),
    Query("spend_by_month", "X06", ["wallet_events"], lambda d: f"""
WITH m AS (SELECT {d.text("CAST(date_trunc('month', ts) AS DATE)")} AS month, sum(actual_units) AS spent FROM {d.wallet_events} WHERE op = 'settle' GROUP BY 1)
SELECT month, CAST(spent AS BIGINT) AS spent, CASE WHEN spent >= 100000 THEN 'cap_100' WHEN spent >= 80000 THEN 'cap_80' ELSE 'ok' END AS alert FROM m"""),
    Query("throttled_reports_candidates", "X09", ["events"], lambda d: f"SELECT user_id AS device, CAST(floor({d.seconds('ts')} / 21600) AS BIGINT) AS slot, min(event_id) AS first_event, count(*) AS asked FROM {d.events} GROUP BY user_id, CAST(floor({d.seconds('ts')} / 21600) AS BIGINT)"),
]
