"""Scripts of plans and terms of both scripts: run profiles, frequent phrases, and the glossary that takes them behind the terms of the screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..plans.query import Built

# Occurrences from which a phrase is a term, terms of a glossary.
OFTEN, MOST = 3, 25
ORIGINS = ("screen", "frequency", "arabic")


def script_profile(blocks: DataFrame) -> DataFrame:
    """Per plan: blocks written from right to left, and runs and characters of each direction (F16)."""
    laid = blocks.select("plan_id", "block_idx", F.col("text"), F.explode_outer(runs.runs(F.col("text"))).alias("r"))
    count = lambda rtl: F.count_if(F.col("r.rtl") == rtl)
    chars = lambda rtl: F.coalesce(F.sum(F.when(F.col("r.rtl") == rtl, F.length("r.text"))), F.lit(0))
    each = laid.groupBy("plan_id", "block_idx").agg(F.max(F.coalesce("r.rtl", F.lit(False))).alias("rtl"), count(True).alias("r"), count(False).alias("l"), chars(True).alias("rc"), chars(False).alias("lc"))
    total = lambda name, to: F.sum(name).cast("long").alias(to)
    return each.groupBy("plan_id").agg(F.count_if("rtl").alias("rtl_blocks"), total("r", "rtl_runs"), total("l", "ltr_runs"), total("rc", "rtl_chars"), total("lc", "ltr_chars"))


def counted_terms(texts: DataFrame, key: str, often: int = OFTEN) -> DataFrame:
    """(key, ``term``, ``origin``, ``n``): Latin phrases and pairs of Arabic words that occur ``often`` times or more."""
    each = lambda terms, origin: texts.select(key, F.explode(terms).alias("term"), F.lit(origin).alias("origin"))
    found = each(runs.latin_phrases(F.col("text")), "frequency").unionByName(each(runs.arabic_pairs(F.col("text")), "arabic"))
    return found.groupBy(key, "term", "origin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def glossary(screen: DataFrame, texts: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """The first ``most`` terms of each key (U02): those of the screen (key, term, n), then Latin phrases, then Arabic pairs, each the most frequent first.

    A term goes if it is, folded, one accepted before or whole words of it. The order decides, so the terms of one key are a fold; of each
    origin only those with the most occurrences that can still be reached are in it.
    """
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    found = screen.select(key, "term", F.lit("screen").alias("origin"), "n").unionByName(counted_terms(texts, key))
    named = found.select(key, F.struct(rank.alias("rank"), (-F.col("n")).alias("minus"), "term", F.lower(runs.folded(F.col("term"))).alias("fold"), "origin", "n").alias("x")).filter("x.fold <> ''")
    first = named.withColumn("place", F.row_number().over(Window.partitionBy(key, "x.fold").orderBy("x"))).filter("place = 1")
    kind = dict(first.dtypes)["x"]
    kept = F.aggregate(
        F.array_sort(F.collect_list("x")), F.array().cast(f"array<{kind}>"),
        lambda done, x: F.when((F.size(done) < most) & ~F.exists(done, lambda y: F.contains(F.concat(F.lit(" "), y["fold"], F.lit(" ")), F.concat(F.lit(" "), x["fold"], F.lit(" ")))), F.concat(done, F.array(x))).otherwise(done),
    )
    return first.groupBy(key).agg(kept.alias("kept")).select(key, F.posexplode("kept").alias("place", "x")).select(key, (F.col("place") + 1).cast("long").alias("place"), "x.term", "x.origin", "x.n")


_RTL = "\\x{0590}-\\x{05FF}\\x{0600}-\\x{06FF}\\x{0700}-\\x{074F}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"
_PHRASES = "(?:^|[^\\p{L}\\p{N}_])([A-Za-z][A-Za-z0-9&/+.-]{2,}(?:\\s+[A-Z][A-Za-z0-9&/+.-]{1,})*)"


def _per_recording(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id", F.col("text_raw").alias("text"))


def _screen_of(segments: DataFrame) -> DataFrame:
    """Terms that stand on a recording's screens: here capitalised pairs of words of its own text, twice or more."""
    pairs = segments.select("recording_id", F.explode(F.regexp_extract_all("text_raw", F.lit(r"[A-Z][a-z]{2,} [a-z]{3,}"), F.lit(0))).alias("term"))
    return pairs.groupBy("recording_id", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


QUERIES = [
    Built("script_profile", "F16", ["plan_blocks"], lambda plan_blocks: script_profile(plan_blocks), f"""
WITH c AS (SELECT plan_id, block_idx, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM plan_blocks),
k AS (SELECT *, CASE WHEN regexp_matches(c, '[{_RTL}]') THEN 1 WHEN regexp_matches(c, '[\\p{{L}}\\p{{N}}]') THEN 0 END AS kind FROM c),
h AS (SELECT *, coalesce(kind, last_value(kind IGNORE NULLS) OVER (PARTITION BY plan_id, block_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS held FROM k),
g AS (SELECT *, CASE WHEN held IS DISTINCT FROM lag(held) OVER (PARTITION BY plan_id, block_idx ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM h)
SELECT plan_id, count(DISTINCT CASE WHEN held = 1 THEN block_idx END) AS rtl_blocks, CAST(sum(CASE WHEN held = 1 THEN fresh ELSE 0 END) AS BIGINT) AS rtl_runs, CAST(sum(CASE WHEN held < 1 THEN fresh ELSE 0 END) AS BIGINT) AS ltr_runs,
       count(CASE WHEN held = 1 THEN 1 END) AS rtl_chars, count(CASE WHEN held < 1 THEN 1 END) AS ltr_chars FROM g GROUP BY plan_id"""),
    Built("frequency_terms", "A19", ["segments"], lambda segments: counted_terms(_per_recording(segments).withColumn("every", F.lit(1)), "every").drop("every"), f"""
WITH p AS (SELECT regexp_replace(unnest(regexp_extract_all(text_raw, '{_PHRASES}', 1)), '\\s+', ' ', 'g') AS term FROM segments),
w AS (SELECT recording_id, segment_id, regexp_extract_all(translate(regexp_replace(regexp_replace(nfc_normalize(text_raw), '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}]', '', 'g'), 'ـ', '', 'g'), 'أإآٱةى', 'ااااهي'), '[\\x{{0621}}-\\x{{064A}}]{{3,}}') AS ws FROM segments),
a AS (SELECT ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] NOT IN {tuple(runs.STOP)} AND ws[i + 1] NOT IN {tuple(runs.STOP)})
SELECT term, 'frequency' AS origin, count(*) AS n FROM p WHERE length(term) >= {runs.PHRASE_CHARS} GROUP BY term HAVING count(*) >= {OFTEN}
UNION ALL SELECT term, 'arabic', count(*) FROM a GROUP BY term HAVING count(*) >= {OFTEN}"""),
    Built("recording_glossary", "U02", ["segments"], lambda segments: glossary(_screen_of(segments), _per_recording(segments), "recording_id"), f"""
WITH s AS (SELECT recording_id, unnest(regexp_extract_all(text_raw, '[A-Z][a-z]{{2,}} [a-z]{{3,}}')) AS term FROM segments),
p AS (SELECT recording_id, regexp_replace(unnest(regexp_extract_all(text_raw, '{_PHRASES}', 1)), '\\s+', ' ', 'g') AS term FROM segments),
f AS (SELECT recording_id, term, 1 AS rank, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2 UNION ALL SELECT recording_id, term, 2, count(*) FROM p WHERE length(term) >= {runs.PHRASE_CHARS} GROUP BY ALL HAVING count(*) >= {OFTEN}),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY recording_id, lower(term) ORDER BY rank, n DESC, term) = 1),
k AS (SELECT recording_id, list_reduce(list([{{'term': term, 'fold': lower(term), 'rank': rank, 'n': n}}] ORDER BY rank, n DESC, term),
  lambda kept, x : CASE WHEN len(kept) >= {MOST} OR len(list_filter(kept, lambda y : contains(' ' || y.fold || ' ', ' ' || x[1].fold || ' '))) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM o GROUP BY recording_id)
SELECT recording_id, i AS place, kept[i].term AS term, CASE kept[i].rank WHEN 1 THEN 'screen' ELSE 'frequency' END AS origin, kept[i].n AS n FROM (SELECT recording_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)"""),
]
