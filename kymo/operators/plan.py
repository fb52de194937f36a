"""Timeline assembly, plan quality and lineage over flattened plan blocks."""

from __future__ import annotations

from ..plans.query import Query

_FIGURES = "f AS (SELECT plan_id, block_idx, trim(text) AS text FROM {plan_blocks} WHERE kind = 'figure')"
_SECTIONS = "sec AS (SELECT recording_id, CAST(floor((segment_id - 1) / 4) AS BIGINT) AS section, min(start_s) AS start_s FROM {segments} GROUP BY recording_id, CAST(floor((segment_id - 1) / 4) AS BIGINT))"


def _twins(d) -> str:
    """Figures whose text is part of another figure's text of the same plan."""
    return f"SELECT DISTINCT a.plan_id, a.block_idx FROM f a JOIN f b ON b.plan_id = a.plan_id AND b.block_idx <> a.block_idx AND length(b.text) >= length(a.text) AND {'contains(b.text, a.text)'}"


#: Names of systems that are said in Arabic and written in Latin letters, each with the spellings that stand for it in a source.
ALIASES = {
    "teams": ("تيمز",), "sharepoint": ("شير بوينت", "شيربوينت"), "excel": ("اكسل", "إكسل", "أكسل"), "word": ("وورد",), "outlook": ("اوتلوك", "أوتلوك", "آوتلوك"),
    "onedrive": ("ون درايف", "وان درايف"), "powerpoint": ("باوربوينت", "بوربوينت", "باور بوينت"), "google": ("جوجل", "قوقل", "غوغل"), "chrome": ("كروم",),
    "email": ("ايميل", "إيميل"), "link": ("لينك",), "observation": ("اوبزرفيشن", "أوبزرفيشن", "ابزرفيشن"), "process": ("بروسيس", "بروسس"), "form": ("فورم",),
    "forms": ("فورمز",), "admin": ("ادمن", "أدمن"), "dashboard": ("داشبورد",), "upload": ("ابلود", "أبلود"), "password": ("باسورد", "باسوورد"), "zoom": ("زوم",), "whatsapp": ("واتساب", "واتس اب"),
}
_ARABIC, _DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
_TOKEN = "[A-Za-z]{4,}|[0-9٠-٩]+(?:[.,][0-9٠-٩]+)?"
_TIME = r"\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?"
_WORD = r"[\p{L}\p{N}_]"
#: A time between what is no part of a word: patterns of the engine that checks can't look ahead, so it replaces twice.
_TIMED = rf"(^|[^{_WORD[1:]}){_TIME}($|[^{_WORD[1:]})"
#: Names and their spellings, as rows for the engine that checks.
_SPELLINGS = ", ".join(f"('{name}', '{spelling}')" for name, of in ALIASES.items() for spelling in of)


def _tokens(d, text: str) -> str:
    """Long words and numbers, each once, as one text with spaces; null if there are none. A shuffle moves these, not a row for each word.

    Numbers keep their fraction; Arabic digits are folded.
    """
    return f"nullif(translate(array_join(array_distinct(transform({d.found(text, _TOKEN)}, x -> lower(x))), ' '), '{_ARABIC}', '{_DIGITS}'), '')"


def _written(text: str) -> str:
    """A text without the times that the program writes itself."""
    return rf"CASE WHEN contains({text}, ':') THEN regexp_replace({text}, r'(?<!{_WORD}){_TIME}(?!{_WORD})', ' ') ELSE {text} END"


def _aliased(text: str) -> str:
    """Names that some spelling in a text stands for, as one text with spaces; null if there are none."""
    names = ", ".join(f"CASE WHEN {' OR '.join(f"contains({text}, '{x}')" for x in of)} THEN '{name}' END" for name, of in ALIASES.items())
    return f"CASE WHEN {text} rlike '[ء-ي]' THEN nullif(concat_ws(' ', {names}), '') END"


QUERIES = [
    Query("merged_timeline", "U01", ["segments", "keyframes"], lambda d: f"""
WITH t AS (SELECT recording_id, start_s AS ts, 1 AS kind_rank, segment_id AS id FROM {d.segments} UNION ALL SELECT recording_id, ts, 0, image_id FROM {d.keyframes})
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ts, kind_rank, id) AS place, CASE kind_rank WHEN 0 THEN 'figure' ELSE 'segment' END AS kind, id FROM t"""),
    Query("figure_sections", "J02", ["segments", "keyframes"], lambda d: f"""
WITH {_SECTIONS.format(segments=d.segments)},
u AS (SELECT recording_id, start_s AS ts, 0 AS kind_rank, section, NULL AS image_id FROM sec UNION ALL SELECT recording_id, ts, 1, NULL, image_id FROM {d.keyframes}),
a AS (SELECT recording_id, image_id, max(section) OVER (PARTITION BY recording_id ORDER BY ts, kind_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, min(section) OVER (PARTITION BY recording_id) AS first_section FROM u)
SELECT recording_id, CAST(image_id AS BIGINT) AS image_id, CAST(coalesce(section, first_section) AS BIGINT) AS section FROM a WHERE image_id IS NOT NULL"""),
    Query("segment_sections", "J03", ["segments"], lambda d: f"""
WITH {_SECTIONS.format(segments=d.segments)},
s AS (SELECT recording_id, section, start_s + CASE WHEN section % 3 = 1 THEN 40.0 ELSE 0.0 END AS start_s FROM sec)
SELECT g.recording_id, g.segment_id, coalesce(max(s.section), 0) AS section FROM {d.segments} g LEFT JOIN s ON s.recording_id = g.recording_id AND g.start_s >= s.start_s GROUP BY g.recording_id, g.segment_id"""),
    Query("unsupported_tokens", "J06", ["plan_blocks", "documents"], lambda d: f"""
WITH u AS (SELECT plan_id, {_tokens(d, _written('text'))} AS said, NULL AS seen FROM {d.plan_blocks} UNION ALL SELECT doc_id, NULL, nullif(concat_ws(' ', {_tokens(d, 'text')}, {_aliased('text')}), '') FROM {d.documents} WHERE doc_id IS NOT NULL),
p AS (SELECT plan_id, array_join(collect_list(said), ' ') AS said, array_join(collect_list(seen), ' ') AS seen FROM u GROUP BY plan_id)
SELECT plan_id, CAST({d.size(f"array_except({d.split('said')}, {d.split('seen')})")} AS BIGINT) AS unsupported FROM p WHERE said <> ''""", sql="""
WITH said AS (SELECT plan_id, list_distinct(flatten(list(regexp_extract_all(translate(lower(regexp_replace(regexp_replace(text, '__TIMED__', '\\1 \\2', 'g'), '__TIMED__', '\\1 \\2', 'g')), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[a-z]{4,}|[0-9]+(?:[.,][0-9]+)?')))) AS toks FROM plan_blocks GROUP BY plan_id),
names AS (SELECT * FROM (VALUES __SPELLINGS__) AS v(name, spelling)),
seen AS (SELECT doc_id AS plan_id, list_distinct(flatten(list(list_concat(regexp_extract_all(translate(lower(text), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[a-z]{4,}|[0-9]+(?:[.,][0-9]+)?'), coalesce((SELECT list(name) FROM names WHERE contains(text, spelling)), []))))) AS toks FROM documents GROUP BY doc_id)
SELECT plan_id, CAST(len(list_filter(said.toks, lambda x : NOT list_contains(coalesce(seen.toks, []), x))) AS BIGINT) AS unsupported FROM said LEFT JOIN seen USING (plan_id) WHERE len(said.toks) > 0""".replace("__TIMED__", _TIMED).replace("__SPELLINGS__", _SPELLINGS)),
    Query("unsourced_sections", "J10", ["plan_blocks"], lambda d: f"""
WITH s AS (SELECT plan_id, section_idx, bool_or(kind = 'paragraph' AND heard) AS spoken, bool_or(kind = 'figure') AS shown FROM {d.plan_blocks} GROUP BY plan_id, section_idx)
SELECT plan_id, section_idx, CASE WHEN shown THEN 'screen_only' ELSE 'model_only' END AS evidence FROM s WHERE NOT spoken"""),
    Query("block_provenance", "J11", ["plan_blocks"], lambda d: f"""
SELECT plan_id, block_idx, CASE WHEN kind = 'paragraph' AND cites_speech AND cites_screen THEN 'both' WHEN kind = 'paragraph' AND cites_speech THEN 'transcript' WHEN kind = 'figure' THEN 'screen' ELSE 'inferred' END AS source FROM {d.plan_blocks}"""),
    Query("reconciled_figures", "J12", ["keyframes", "plan_blocks"], lambda d: f"""
WITH used AS (SELECT plan_id % 10 AS recording_id, plan_id * 3 % 500 AS image_id, min(plan_id * 1000 + block_idx) AS place FROM {d.plan_blocks} WHERE kind = 'figure' GROUP BY plan_id % 10, plan_id * 3 % 500),
sent AS (SELECT recording_id, image_id, ts FROM {d.keyframes}),
kept AS (SELECT s.recording_id, s.image_id, s.ts, u.place FROM sent s JOIN used u ON u.recording_id = s.recording_id AND u.image_id = s.image_id),
forgot AS (SELECT * FROM sent s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.recording_id = s.recording_id AND k.image_id = s.image_id))
SELECT f.recording_id, f.image_id, max_by(k.image_id, k.ts) AS after_image FROM forgot f LEFT JOIN kept k ON k.recording_id = f.recording_id AND k.ts <= f.ts GROUP BY f.recording_id, f.image_id"""),
    Query("merged_plans", "J19", ["plan_blocks"], lambda d: f"""
WITH p AS (SELECT plan_id, plan_id % 4 AS part, block_idx, section_idx, text FROM {d.plan_blocks}),
heads AS (SELECT part, min(plan_id) AS plan_id FROM p GROUP BY part)
SELECT plan_id, part, (part + 1) * 100000 + block_idx AS block_id, least(3, section_idx % 3 + 2) AS level, false AS heading FROM p UNION ALL SELECT plan_id, part, (part + 1) * 100000 - 1, 1, true FROM heads"""),
    Query("figure_twins", "J23", ["plan_blocks"], lambda d: f"WITH {_FIGURES.format(plan_blocks=d.plan_blocks)} {_twins(d)}"),
    Query("plan_violations", "A11 U06", ["plan_blocks"], lambda d: f"""
SELECT plan_id, count(*) - count(DISTINCT cited_segment) AS duplicate_segments, max(block_idx) + 1 - count(DISTINCT block_idx) AS missing_segments, count(DISTINCT section_idx) = 0 AS no_sections FROM {d.plan_blocks} GROUP BY plan_id"""),
    Query("plan_outputs", "A12 A06", ["plan_blocks"], lambda d: f"""
SELECT plan_id, count(DISTINCT section_idx) AS sections, count(DISTINCT CASE WHEN kind = 'figure' THEN block_idx END) AS figures, count(DISTINCT CASE WHEN kind = 'paragraph' THEN block_idx END) AS segments FROM {d.plan_blocks} GROUP BY plan_id"""),
    Query("provenance_summary", "A13", ["plan_blocks"], lambda d: f"""
WITH b AS (SELECT plan_id, section_idx, CASE WHEN kind = 'figure' THEN 'screen' WHEN NOT cites_speech THEN 'inferred' ELSE 'transcript' END AS source FROM {d.plan_blocks})
SELECT plan_id, count(CASE WHEN source = 'transcript' THEN 1 END) AS transcript, count(CASE WHEN source = 'screen' THEN 1 END) AS screen, count(CASE WHEN source = 'inferred' THEN 1 END) AS inferred, round(100.0 * count(CASE WHEN source <> 'inferred' THEN 1 END) / count(*), 4) AS sourced_percent FROM b GROUP BY plan_id"""),
    Query("content_span", "A14", ["segments", "keyframes"], lambda d: f"""
WITH k AS (SELECT recording_id, max(ts) AS last_frame, max(CASE WHEN privacy_scanned THEN ts END) AS last_figure FROM {d.keyframes} GROUP BY recording_id),
t AS (SELECT recording_id, max(end_s) AS duration FROM {d.segments} GROUP BY recording_id)
SELECT s.recording_id, max(last_frame) AS last_frame, max(last_figure) AS last_figure, round(max(duration - last_figure), 3) AS tail, round(sum(greatest(0.0, end_s - greatest(start_s, last_figure))), 3) AS speech_after, max(duration - last_figure) >= greatest(180.0, 0.25 * max(duration)) AS warned
FROM {d.segments} s JOIN k ON k.recording_id = s.recording_id JOIN t ON t.recording_id = s.recording_id GROUP BY s.recording_id"""),
    Query("title_defects", "P12 P14 P15", ["plan_blocks"], lambda d: f"""
WITH t AS (SELECT plan_id, section_idx, min_by(substr(text, 1, 60), block_idx) AS title FROM {d.plan_blocks} GROUP BY plan_id, section_idx)
SELECT plan_id, section_idx, length(trim(title)) < 12 AS too_short, {d.size(d.split('title'))} > 14 AS too_long, {d.matches('title', 'https?://|[|]')} AS web_or_bar, {d.matches('title', '[#%&*$]{2,}')} AS misread, {d.matches('title', '^[^A-Za-z]*$')} AS no_letters, {d.matches('lower(title)', '([a-z]{3,}) [^ ]* ?[^ ]* ?$')} AS open_end FROM t"""),
    Query("clean_titles", "P13 F12 F17", ["plan_blocks"], lambda d: f"""
WITH t AS (SELECT plan_id, section_idx, min_by(text, block_idx) AS title FROM {d.plan_blocks} GROUP BY plan_id, section_idx),
o AS (SELECT plan_id, section_idx, {d.replace(d.replace("title", '^(?:(?:The|And|So|Is|In) )+', ''), '[^A-Za-z0-9]+$', '')} AS title FROM t)
SELECT plan_id, section_idx, CASE WHEN length(title) <= 70 THEN title ELSE {d.replace('substr(title, 1, 70)', ' [^ ]*$', '')} END AS title FROM o"""),
    Query("alt_texts", "P24", ["plan_blocks"], lambda d: f"""
WITH n AS (SELECT plan_id, block_idx, trim(text) AS text, row_number() OVER (PARTITION BY plan_id ORDER BY block_idx) AS n FROM {d.plan_blocks} WHERE kind = 'figure')
SELECT plan_id, block_idx, substr(CASE WHEN length(text) >= 12 AND block_idx % 8 = 3 THEN concat(text, ' - ', substr(text, 1, 40)) WHEN length(text) >= 12 THEN text ELSE concat('Figure ', {d.text('n')}) END, 1, 220) AS alt_text FROM n"""),
    Query("block_search", "P28", ["plan_blocks"], lambda d: f"""
SELECT plan_id, section_idx, count(*) AS blocks, CAST(sum(length(lower(text)) - length(replace(lower(text), 'licen', 'lice'))) AS BIGINT) AS hits FROM {d.plan_blocks} WHERE contains(lower(text), 'licen') GROUP BY plan_id, section_idx"""),
    Query("section_bullets", "A29", ["plan_blocks"], lambda d: f"""
WITH c AS (SELECT plan_id, section_idx, block_idx, CASE WHEN kind = 'figure' THEN 1 WHEN {d.matches('text', '^[0-9]')} THEN 2 ELSE 3 END AS rank, {d.replace('text', '^([^.]*[.]).*$', '$1')} AS bullet FROM {d.plan_blocks}),
b AS (SELECT *, min(rank) OVER (PARTITION BY plan_id, section_idx) AS best FROM c WHERE length(bullet) >= 30)
SELECT plan_id, section_idx, n, bullet FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, section_idx ORDER BY block_idx) AS n FROM b WHERE rank = best) x WHERE n <= 3"""),
]
