"""Screen text and privacy: reading lines, identifiers, names, and the rows that must be hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Built, Dialect, Query
from .lines import lines, text_of

# Words of login screens and labels.
_STRONG = "(password|passwd|sign in|log in|forgot your)"
_WEAK = "(account|user ?name|email)"
_CONTEXT = "(enter|submit|continue|remember)"
_URL = r"(?:https?://|www[.])[^ ]+|[a-z0-9.-]+[.](?:com|org|net|edu)[^ ]*"
_INLINE, _LABEL = "^(?:The|Is|By|Of)[ :]+[A-Z][a-z]+", "^(?:teacher|by|name)[: ]*$"
#: A token counts as an identifier from this many digits and this share of them.
DIGITS, SHARE = 9, 0.75

_LINES = "lines AS (SELECT image_id, line, avg(conf) AS conf, {text} AS text, min(left_px) AS left_px, min(top_px) AS top_px, max(left_px + width_px) AS right_px, avg(height_px) AS height_px FROM {ocr_words} GROUP BY image_id, line)"


def _lines(d) -> str:
    return _LINES.format(text=d.join("text", " ", "word_idx"), ocr_words=d.ocr_words)


def _name_lines(d) -> str:
    """Lines of which every word may be part of a name; texts of other words are not kept, so they are neither shuffled nor sorted."""
    if not d.spark:
        return _lines(d)
    part = d.matches("text", "^[A-Z][a-z]+(?: [A-Z][a-z]+)*[.]?$")
    return f"lines AS (SELECT image_id, line, {d.join(f'CASE WHEN {part} THEN text END', ' ', 'word_idx')} AS text FROM {d.ocr_words} GROUP BY image_id, line HAVING count(CASE WHEN NOT {part} THEN 1 END) = 0)"


def _ids(d) -> str:
    """Words with their centre, their digits, and whether they are identifiers."""
    return f"""w AS (SELECT *, left_px + width_px / 2.0 AS centre, {d.size(d.found('text', '[0-9]'))} AS digits, length({d.replace('text', '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '')}) AS body FROM {d.ocr_words}),
ids AS (SELECT * FROM w WHERE digits >= {DIGITS} AND digits >= {SHARE} * body)"""


_BANDS = "b AS (SELECT image_id, line, min(top_px) AS top_px, max(top_px + height_px) AS bottom_px, min(left_px) AS left_px FROM {ocr_words} WHERE line % 3 <> 1 GROUP BY image_id, line)"

#: What hides secrets, in this order: the reference's five patterns, then keys in hex, other assignments and addresses.
_SECRETS = (
    (r"(?iU)(bearer\s+)[A-Za-z0-9._~+/-]+", "$1[REDACTED]"),
    (r"(?iU)(api[_-]?key\s*[:=]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"(?iU)hf_[A-Za-z0-9._-]+", "[REDACTED_HF_TOKEN]"),
    (r"(?iU)sk-[A-Za-z0-9._-]+", "[REDACTED_API_KEY]"),
    (r"(?iU)(token\s*[:=]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"[0-9a-f]{32,}", "***"),
    (r"(secret|password) *[=:] *[^ ]+", "$1=***"),
    (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "***"),
)


def _scrubbed(d) -> str:
    """Every document with its whole text scrubbed."""
    text = "text"
    for pattern, by in _SECRETS:
        text = d.replace(text, pattern, by)
    return f"SELECT doc_id, {text} AS text FROM {d.documents}"


_SQL = Dialect(False)


def _confident(ocr_words: DataFrame) -> DataFrame:
    """Lines of a mean confidence of at least 75, with their words in order."""
    found = lines(ocr_words, conf=F.col("conf")).filter("conf >= 75")
    return found.select("image_id", "line", F.round("conf", 4).alias("conf"), text_of(F.col("runs")).alias("text"))


def _labelled(ocr_words: DataFrame) -> DataFrame:
    """Names behind a label, or on the line after it; an image's lines lie in one task, so the next line needs no other shuffle."""
    found = lines(ocr_words, "image_id").select("image_id", "line", text_of(F.col("runs")).alias("text"))
    found = found.withColumn("next_text", F.lead("text").over(Window.partitionBy("image_id").orderBy("line")))
    inline, label = F.col("text").rlike(_INLINE), F.lower("text").rlike(_LABEL) & F.coalesce("next_text", F.lit("")).rlike("^[A-Z][a-z]+")
    return found.filter(inline | label).select("image_id", "line", F.when(inline, F.col("text")).otherwise(F.col("next_text")).alias("name"))


def _scrubbed_word(d) -> str:
    return f"CASE WHEN {d.matches('lower(text)', _URL)} THEN {d.replace('lower(text)', '^(?:https?://)?(?:www[.])?([a-z0-9.-]+).*$', '$1')} WHEN {d.size(d.found('text', '[0-9]'))} >= {DIGITS} THEN '' ELSE text END"


def _shown(ocr_words: DataFrame) -> DataFrame:
    """Lines without identifiers and with hosts for addresses. Words of which nothing is left are in no run."""
    left = ocr_words.select("image_id", "line", "word_idx", F.expr(_scrubbed_word(Dialect(True))).alias("text")).filter("text <> ''")
    return lines(left).select("image_id", "line", text_of(F.col("runs")).alias("text")).filter("length(text) >= 2")


QUERIES = [
    Built("confident_lines", "A16", ["ocr_words"], _confident, sql=f"WITH {_lines(_SQL)} SELECT image_id, line, round(conf, 4) AS conf, text FROM lines WHERE conf >= 75"),
    Query("login_screens", "P06", ["documents"], lambda d: f"""
SELECT doc_id AS image_id, {d.matches('lower(text)', _STRONG)} AS strong, {d.matches('lower(text)', _WEAK)} AND {d.matches('lower(text)', _CONTEXT)} AS weak FROM {d.documents}"""),
    Query("identifier_tokens", "P07", ["ocr_words"], lambda d: f"WITH {_ids(d)} SELECT image_id, line, word_idx, text FROM ids"),
    Query("url_tokens", "P08", ["ocr_words"], lambda d: f"""
SELECT image_id, line, word_idx, {d.replace("lower(text)", '^(?:https?://)?(?:www[.])?', '')} AS tail, {d.matches('text', '^(?:[A-Za-z]:|/|~)[^ ]+/')} AS is_path FROM {d.ocr_words} WHERE {d.matches('lower(text)', _URL)}"""),
    Query("person_names", "P09", ["ocr_words"], lambda d: f"""
WITH {_name_lines(d)}
SELECT image_id, line, text FROM lines WHERE {d.matches('text', '^[A-Z][a-z]+ [A-Z][a-z]+(?: [A-Z][a-z]+)?(?: [A-Z][a-z]+)?[.]?$')} AND NOT {d.matches('lower(text)', '(^| )(file|edit|view|save|open|help|search|settings)( |$)')}"""),
    Query("scrubbed_logs", "P23", ["documents"], _scrubbed, sql=r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._~+/-]+', '\1[REDACTED]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?i)(api[_-]?key\s*[:=]\s*)[^\s,;]+', '\1[REDACTED]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)hf_[A-Za-z0-9._-]+', '[REDACTED_HF_TOKEN]', 'g'), '(?i)sk-[A-Za-z0-9._-]+', '[REDACTED_API_KEY]', 'g') AS t FROM b),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)(token\s*[:=]\s*)[^\s,;]+', '\1[REDACTED]', 'g'), '[0-9a-f]{32,}', '***', 'g') AS t FROM c)
SELECT doc_id, regexp_replace(regexp_replace(t, '(secret|password) *[=:] *[^ ]+', '\1=***', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '***', 'g') AS text FROM e"""),
    Query("anchored_rows", "J14", ["ocr_words"], lambda d: f"""
WITH {_ids(d)}
SELECT a.image_id, a.line, a.word_idx AS anchor, count(*) AS words, min(b.left_px) AS left_px, max(b.left_px + b.width_px) AS right_px FROM ids a JOIN w b ON b.image_id = a.image_id AND b.line = a.line AND abs(b.centre - a.centre) <= 260 GROUP BY a.image_id, a.line, a.word_idx"""),
    Query("partial_ids", "J15", ["ocr_words"], lambda d: f"""
WITH {_ids(d)}
SELECT p.image_id, p.line, p.word_idx, count(*) AS full_ids FROM w p JOIN ids i ON i.image_id = p.image_id AND abs(i.centre - p.centre) <= 45 AND (i.line <> p.line OR i.word_idx <> p.word_idx) WHERE p.digits >= 5 GROUP BY p.image_id, p.line, p.word_idx HAVING count(*) >= 2"""),
    Query("same_column_rows", "J16", ["ocr_words"], lambda d: f"""
WITH f AS (SELECT image_id, line, min(left_px) AS left_px, avg(height_px) AS height_px, min_by(text, word_idx) AS first_word FROM {d.ocr_words} GROUP BY image_id, line),
h AS (SELECT * FROM f WHERE {d.matches('first_word', '^[A-Z][a-z]+$')} AND line % 4 = 0),
m AS (SELECT f.image_id, f.line, count(*) AS hidden FROM f JOIN h ON h.image_id = f.image_id AND h.line <> f.line AND abs(h.left_px - f.left_px) <= 12 AND f.height_px / h.height_px BETWEEN 0.6 AND 1.6 GROUP BY f.image_id, f.line)
SELECT image_id, line, hidden FROM m WHERE hidden >= 2"""),
    Built("labelled_names", "J17", ["ocr_words"], _labelled, sql=f"""
WITH {_lines(_SQL)},
n AS (SELECT *, lead(text) OVER (PARTITION BY image_id ORDER BY line) AS next_text FROM lines)
SELECT image_id, line, CASE WHEN {_SQL.matches('text', _INLINE)} THEN text ELSE next_text END AS name FROM n
WHERE {_SQL.matches('text', _INLINE)} OR ({_SQL.matches('lower(text)', _LABEL)} AND {_SQL.matches("coalesce(next_text, '')", '^[A-Z][a-z]+')})"""),
    Query("redaction_counts", "A25 F19", ["ocr_words"], lambda d: f"""
WITH {_ids(d)}
SELECT image_id, sum(CASE WHEN digits >= {DIGITS} AND digits >= {SHARE} * body THEN 1 ELSE 0 END) AS id_row, sum(CASE WHEN {d.matches('lower(text)', _URL)} THEN 1 ELSE 0 END) AS url,
       sum(CASE WHEN {d.matches('text', '^(?:/|~)[^ ]+/')} THEN 1 ELSE 0 END) AS path FROM w GROUP BY image_id"""),
    Built("scrubbed_screen_text", "F19", ["ocr_words"], _shown, sql=f"""
WITH k AS (SELECT image_id, line, word_idx, {_scrubbed_word(_SQL)} AS text FROM {_SQL.ocr_words}),
l AS (SELECT image_id, line, {_SQL.join('text', ' ', 'word_idx', where="text <> ''")} AS text FROM k GROUP BY image_id, line)
SELECT image_id, line, text FROM l WHERE length(text) >= 2"""),
    Query("inferred_rows", "W26", ["ocr_words"], lambda d: f"""
WITH {_BANDS.format(ocr_words=d.ocr_words)},
g AS (SELECT *, lead(top_px) OVER (PARTITION BY image_id ORDER BY top_px) - top_px AS step FROM b),
r AS (SELECT image_id, step, row_number() OVER (PARTITION BY image_id ORDER BY step) AS rn, count(step) OVER (PARTITION BY image_id) AS n FROM g WHERE step IS NOT NULL),
m AS (SELECT image_id, max(CASE WHEN rn = CAST(floor(n / 2) AS BIGINT) + 1 THEN step END) AS mid, max(n) AS n FROM r GROUP BY image_id)
SELECT g.image_id, g.top_px, g.step, mid, CAST(floor(g.step / mid + 0.5) AS BIGINT) - 1 AS missing FROM g JOIN m ON m.image_id = g.image_id
WHERE n >= 2 AND g.step > mid AND floor(g.step / mid + 0.5) BETWEEN 2 AND 4 AND abs(g.step / mid - floor(g.step / mid + 0.5)) <= 0.25"""),
    Query("static_bands", "W27", ["embeddings"], lambda d: f"""
WITH p AS (SELECT label, vec_id, CAST(v AS DOUBLE) AS v, i AS px_row FROM {d.unnest(d.embeddings, 'embedding', 'v', 'i')} x),
s AS (SELECT label, px_row, max(v) - min(v) AS spread FROM p GROUP BY label, px_row),
t AS (SELECT label, px_row, spread, percent_rank() OVER (PARTITION BY label ORDER BY spread, px_row) AS pr FROM s),
f AS (SELECT label, min(CASE WHEN pr > 0.3 THEN px_row END) AS first_moving, max(CASE WHEN pr > 0.3 THEN px_row END) AS last_moving, count(*) AS n FROM t GROUP BY label)
SELECT label AS recording_id, least(first_moving - 1, CAST(floor(n * 0.25) AS BIGINT)) AS top_rows, least(n - last_moving, CAST(floor(n * 0.12) AS BIGINT)) AS bottom_rows FROM f"""),
    Query("stage_bounds", "W34", ["embeddings"], lambda d: f"""
WITH p AS (SELECT label, CAST(v AS DOUBLE) AS v, i AS col FROM {d.unnest(d.embeddings, 'embedding', 'v', 'i')} x),
m AS (SELECT label, col, median(v) AS dark FROM p GROUP BY label, col),
b AS (SELECT label, col, col - row_number() OVER (PARTITION BY label ORDER BY col) AS run FROM m WHERE dark < 0.0),
r AS (SELECT label, min(col) AS a, max(col) AS z, count(*) AS n FROM b GROUP BY label, run)
SELECT label AS recording_id, min(CASE WHEN rn = 1 THEN a END) AS left_col, max(CASE WHEN rn = 1 THEN z END) AS right_col FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, a) AS rn FROM r) x GROUP BY label"""),
    Query("name_spans", "W35", ["ocr_words"], lambda d: f"""
WITH c AS (SELECT image_id, line, word_idx, text, CASE WHEN {d.matches('text', '^[A-Z][a-z]+[.,]?$')} THEN 1 ELSE 0 END AS cap FROM {d.ocr_words}),
i AS (SELECT *, word_idx - row_number() OVER (PARTITION BY image_id, line ORDER BY word_idx) AS run FROM c WHERE cap = 1),
s AS (SELECT image_id, line, min(word_idx) AS first_word, max(word_idx) AS last_word, count(*) AS n, {d.join('text', ' ', 'word_idx')} AS name FROM i GROUP BY image_id, line, run)
SELECT image_id, line, first_word, last_word, name FROM s WHERE n BETWEEN 2 AND 4"""),
    Query("egress_gate", "P05", ["keyframes"], lambda d: f"""
SELECT recording_id, (bool_or(redaction_failed) OR bool_or(NOT privacy_scanned)) AND bool_or(anonymised) AS blocked FROM {d.keyframes} GROUP BY recording_id"""),
    Query("withheld_figures", "P04", ["keyframes"], lambda d: f"""
SELECT recording_id, CASE WHEN NOT privacy_scanned THEN 'unscanned' WHEN redaction_failed THEN 'redaction_failed' WHEN sensitive THEN 'sensitive' ELSE 'kept' END AS reason, count(*) AS figures FROM {d.keyframes}
GROUP BY recording_id, CASE WHEN NOT privacy_scanned THEN 'unscanned' WHEN redaction_failed THEN 'redaction_failed' WHEN sensitive THEN 'sensitive' ELSE 'kept' END"""),
]
