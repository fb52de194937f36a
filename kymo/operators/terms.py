"""Terminology: runs on screen lines, frequent phrases, glossaries; and study items checked against their sources."""

from __future__ import annotations

from ..plans.query import Query

# Small words that make no term.
_STOP = "('the', 'and', 'of', 'to', 'in', 'is', 'that', 'it', 'for', 'was', 'with', 'this', 'are', 'from', 'by', 'on', 'at', 'be')"


# Two to four Latin words.
_RUN = "[A-Za-z]{3,}(?: [A-Za-z]{3,}){1,3}"


def _runs(d) -> str:
    """Runs of two to four Latin words on a screen line."""
    return f"""r AS (SELECT plan_id, block_idx, run FROM {d.unnest("(SELECT plan_id, block_idx, " + d.found('text', _RUN) + " AS runs FROM " + d.plan_blocks + ") q", 'runs', 'run', 'i')} x)"""


def _cut(d, text: str) -> str:
    return d.split(d.replace(f"lower({text})", "[^a-z ]+", " "))


def _words(d, source: str, key: str, text: str) -> str:
    return d.unnest(f"(SELECT {key}, {_cut(d, text)} AS ws FROM {source}) q", "ws", "w", "i")


def _items(d) -> str:
    """Study items derived from blocks: a term, an answer, and the block that they cite."""
    return f"""items AS (SELECT plan_id, block_idx AS item, CASE block_idx % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'flashcard' ELSE 'glossary' END AS item_type,
 trim(substr(text, 1, 24)) AS front, trim(substr(text, 10, 40)) AS answer, block_idx - block_idx % 4 AS cited FROM {d.plan_blocks})"""


#: The first 25 that aren't whole words of a term accepted before them: a fold over the candidates of one plan, each with a space at both ends. A term
#: that comes again is part of itself, or of what kept it out, so candidates need not be distinct.
_ACCEPTED = """k AS (SELECT plan_id, aggregate(sort_array(flatten(collect_list(terms))), CAST(array() AS ARRAY<STRUCT<origin: INT, place: BIGINT, term: STRING>>),
 (kept, x) -> CASE WHEN size(kept) < 25 AND NOT exists(kept, y -> contains(y.term, x.term)) THEN concat(kept, array(x)) ELSE kept END) AS kept FROM u GROUP BY plan_id)
SELECT plan_id, trim(x.term) AS term, CASE x.origin WHEN 1 THEN 'screen' ELSE 'frequency' END AS origin FROM k LATERAL VIEW explode(kept) e AS x"""

QUERIES = [
    Query("screen_terms", "A17", ["plan_blocks"], lambda d: f"WITH {_runs(d)} SELECT lower(run) AS term, count(*) AS n FROM r WHERE NOT {d.matches('run', 'https?|www')} GROUP BY lower(run) HAVING count(*) >= 2"),
    Query("merged_glossaries", "A18", ["plan_blocks"], lambda d: f"""
WITH {_runs(d)}, c AS (SELECT plan_id % 5 AS recording, lower(run) AS term, count(*) AS n FROM r GROUP BY plan_id % 5, lower(run)),
t AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY term) SELECT term, n FROM t WHERE n >= 3 ORDER BY n DESC, term"""),
    Query("noise_terms", "P16", ["plan_blocks"], lambda d: f"""
WITH {_runs(d)} SELECT DISTINCT lower(run) AS term, {d.size(d.split('run'))} > 4 OR {d.matches('lower(run)', '^(?:file|edit|view|help)( |$)')} OR {d.matches('run', '^(?:[A-Z][a-z]+ ?)+$')} AS noise FROM r"""),
    Query("ranked_terms", "T06", ["plan_blocks"], lambda d: f"""
WITH {_runs(d)}, c AS (SELECT plan_id, lower(run) AS term, count(*) AS n FROM r GROUP BY plan_id, lower(run)), k AS (SELECT *, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id) AS repeated FROM c)
SELECT plan_id, term, n, row_number() OVER (PARTITION BY plan_id ORDER BY n DESC, length(term) DESC, term) AS place FROM k WHERE n >= 2 OR repeated < 3"""),
    Query("glossary_candidates", "U02 U04", ["plan_blocks", "documents"], lambda d: f"""
WITH u AS (SELECT plan_id, transform({d.found('text', _RUN)}, run -> struct(1 AS origin, CAST(block_idx AS BIGINT) AS place, concat(' ', lower(run), ' ') AS term)) AS terms FROM {d.plan_blocks}
      UNION ALL SELECT doc_id, filter(transform({_cut(d, 'text')}, (w, i) -> CASE WHEN length(w) > 7 THEN struct(2 AS origin, CAST(i + 1 AS BIGINT) AS place, concat(' ', w, ' ') AS term) END), x -> x IS NOT NULL) FROM {d.documents}),
{_ACCEPTED}""", sql="""
WITH runs AS (SELECT plan_id, block_idx, unnest(regexp_extract_all(text, '[A-Za-z]{3,}(?: [A-Za-z]{3,}){1,3}')) AS run FROM plan_blocks),
ws AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' '), 1) AS i FROM documents),
found AS (SELECT plan_id, lower(run) AS term, 1 AS origin, min(block_idx) AS place FROM runs GROUP BY ALL UNION ALL SELECT doc_id, w, 2, min(i) FROM ws WHERE length(w) > 7 GROUP BY ALL),
ranked AS (SELECT plan_id, term, arg_min(place, origin) AS place, min(origin) AS origin FROM found GROUP BY plan_id, term),
folded AS (SELECT plan_id, list_reduce(list([{'term': term, 'origin': origin}] ORDER BY origin, place, term),
 lambda kept, x : CASE WHEN len(kept) >= 25 OR len(list_filter(kept, lambda y : contains(' ' || y.term || ' ', ' ' || x[1].term || ' '))) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM ranked GROUP BY plan_id)
SELECT plan_id, k.term AS term, CASE k.origin WHEN 1 THEN 'screen' ELSE 'frequency' END AS origin FROM (SELECT plan_id, unnest(kept) AS k FROM folded)"""),
    Query("augmented_glossary", "U03", ["plan_blocks", "documents"], lambda d: f"""
WITH {_runs(d)}, g AS (SELECT DISTINCT plan_id, lower(run) AS term FROM r),
s AS (SELECT doc_id AS plan_id, w AS term, count(*) AS n FROM {_words(d, d.documents, 'doc_id', 'text')} x WHERE length(w) > 5 GROUP BY doc_id, w HAVING count(*) >= 2),
n AS (SELECT s.*, row_number() OVER (PARTITION BY plan_id ORDER BY n DESC, term) AS place FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.plan_id = s.plan_id AND g.term = s.term))
SELECT plan_id, term, n FROM n WHERE place <= 10"""),
    Query("scrubbed_person_terms", "F20", ["plan_blocks"], lambda d: f"""
WITH {_runs(d)} SELECT plan_id, count(*) AS kept FROM r WHERE NOT {d.matches('run', '^[A-Z][a-z]+ [A-Z][a-z]+$')} GROUP BY plan_id"""),
    Query("resolved_sources", "J07", ["plan_blocks"], lambda d: f"""
WITH {_items(d)} SELECT i.plan_id, i.item, count(*) AS sources, min(b.source_start) AS start_s, max(b.source_end) AS end_s FROM items i JOIN {d.plan_blocks} b ON b.plan_id = i.plan_id AND b.block_idx IN (i.cited, i.cited + 1) AND b.kind = 'paragraph' GROUP BY i.plan_id, i.item"""),
    Query("supported_answers", "J08 F06", ["plan_blocks"], lambda d: f"""
WITH {_items(d)},
a AS (SELECT DISTINCT plan_id, item, cited, w FROM {_words(d, 'items', 'plan_id, item, cited', 'answer')} x WHERE length(w) >= 3),
n AS (SELECT plan_id, item, count(*) AS tokens FROM a GROUP BY plan_id, item),
s AS (SELECT DISTINCT plan_id, block_idx, w FROM {_words(d, d.plan_blocks, 'plan_id, block_idx', 'text')} x WHERE length(w) >= 3),
h AS (SELECT a.plan_id, a.item, count(*) AS shared FROM a JOIN s ON s.plan_id = a.plan_id AND s.block_idx = a.cited AND s.w = a.w GROUP BY a.plan_id, a.item)
SELECT n.plan_id, n.item, tokens < 2 OR coalesce(shared, 0) >= 1 AS supported FROM n LEFT JOIN h ON h.plan_id = n.plan_id AND h.item = n.item"""),
    Query("terms_in_source", "J09", ["plan_blocks"], lambda d: f"""
WITH {_items(d)} SELECT i.plan_id, i.item, contains(lower(b.text), lower(i.front)) AS literal FROM items i JOIN {d.plan_blocks} b ON b.plan_id = i.plan_id AND b.block_idx = i.cited WHERE item_type = 'glossary'"""),
    Query("applied_translations", "J13", ["segments"], lambda d: f"""
WITH b AS (SELECT *, CAST(floor((segment_id - 1) / 5) AS BIGINT) AS batch FROM {d.segments}),
r AS (SELECT recording_id, segment_id, batch, concat('[', text_clean, ']') AS reply FROM b WHERE (recording_id * 31 + segment_id) % 23 <> 0),
g AS (SELECT b.recording_id, b.batch, count(*) = count(r.segment_id) AS whole FROM b LEFT JOIN r ON r.recording_id = b.recording_id AND r.segment_id = b.segment_id GROUP BY b.recording_id, b.batch)
SELECT b.recording_id, b.segment_id, CASE WHEN whole THEN reply ELSE text_clean END AS text FROM b JOIN g ON g.recording_id = b.recording_id AND g.batch = b.batch LEFT JOIN r ON r.recording_id = b.recording_id AND r.segment_id = b.segment_id"""),
    Query("deduplicated_items", "U04 F22", ["plan_blocks"], lambda d: f"""
WITH {_items(d)}, f AS (SELECT *, trim({d.replace('lower(front)', '[^a-z0-9]+', ' ')}) AS folded FROM items WHERE length(answer) > 3)
SELECT plan_id, item, item_type FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, item_type, folded ORDER BY item) AS rn FROM f) x WHERE rn = 1"""),
    Query("capped_items", "T08", ["plan_blocks"], lambda d: f"""
WITH {_items(d)} SELECT plan_id, item, item_type FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, item_type ORDER BY item) AS rn FROM items) x WHERE rn <= CASE item_type WHEN 'glossary' THEN 25 WHEN 'question' THEN 20 ELSE 30 END"""),
    Query("graded_questions", "A28", ["plan_blocks"], lambda d: f"WITH {_items(d)} SELECT plan_id, count(CASE WHEN item_type = 'question' AND item % 2 = 0 THEN 1 END) AS graded, count(*) AS items FROM items GROUP BY plan_id"),
]
