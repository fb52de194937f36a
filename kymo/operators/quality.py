"""Quality of document plans: six metrics, from 0 to 100 each, and their weighted mean.

Every plan's blocks are shuffled once, by plan; windows, sections and sums follow on that partitioning. Titles and captions are judged by
the rules of ``functions.titles``: a title that a second section has too is none, and a caption is judged without its time.

A metric that doesn't apply is null and has no weight: captions without figures, likeness without two figures of some text, balance
without two sections of some text, and all of a plan without blocks of their kind. A missing text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles
from ..plans.query import Built

# Bounds of paragraphs, the pause that ends one, and the weight of each metric.
SHORT, LONG, PAUSE = 180, 1400, 1.0
WEIGHTS = {"paragraph_flow": 0.30, "paragraph_balance": 0.20, "section_titling": 0.20, "section_balance": 0.10, "figure_captioning": 0.15, "figure_distinctness": 0.05}


def described(caption: Column) -> Column:
    """Does a caption say what its figure shows?"""
    plain = titles.stripped(titles.any_text(caption))
    return (plain != "") & ~plain.rlike(titles.GENERIC) & (F.size(titles.title_defects(F.regexp_replace(plain, titles.STAMP, ""))) == 0)


def repeated(texts: Column) -> Column:
    """How many texts are part of another one."""
    return F.size(F.filter(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: F.exists(F.sequence(F.lit(0), F.size(texts) - 1), lambda j: (i != j) & F.contains(F.get(texts, j), F.get(texts, i)))))


def metrics(blocks: DataFrame) -> DataFrame:
    """Per plan a column for each metric. ``blocks``: plan_id, section_idx, section_title, block_idx, kind, text, caption, ocr_text, source_start, source_end."""
    figure = F.col("kind") == "figure"
    text = titles.stripped(titles.any_text(F.col("text")))
    after = F.lead("source_start").over(Window.partitionBy("plan_id", figure).orderBy("block_idx"))
    laid = blocks.repartition("plan_id").withColumn("next_start", after)
    ends = titles.ends_sentence(text) | F.coalesce(F.col("next_start") - F.col("source_end") >= PAUSE, F.lit(False))
    count = lambda rule: F.count_if(rule)
    screen = titles.stripped(titles.any_text(F.col("ocr_text")))
    sections = laid.groupBy("plan_id", "section_idx").agg(
        F.first("section_title", ignorenulls=True).alias("title"), F.sum(F.length(titles.any_text(F.col("text")))).alias("size"),
        count(~figure).alias("texts"), count(~figure & ends).alias("ended"), count(~figure & F.length(text).between(SHORT, LONG)).alias("within"),
        count(figure).alias("figures"), count(figure & described(F.col("caption"))).alias("described"), F.collect_list(F.when(figure & (screen != ""), screen)).alias("screens"),
    )
    name = F.regexp_replace(titles.stripped(titles.any_text(F.col("title"))), r"(?U)\s+", " ")
    judged = sections.withColumn("name", name).withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("plan_id", "name")))
    good = (F.col("name") != "") & (F.col("twins") == 1) & (F.size(titles.title_defects(F.col("title"))) == 0)
    size = F.when(F.col("size") > 0, F.col("size"))
    percent = lambda part, whole: F.when(whole > 0, 100.0 * part / whole)
    balance = F.greatest(F.lit(0.0), 100.0 * (1.0 - F.least(F.lit(1.0), F.stddev_pop(size) / F.avg(size))))
    totals = judged.groupBy("plan_id").agg(
        percent(F.sum("ended"), F.sum("texts")).alias("paragraph_flow"), percent(F.sum("within"), F.sum("texts")).alias("paragraph_balance"), percent(count(good), F.count(F.lit(1))).alias("section_titling"),
        F.when(F.count(size) >= 2, balance).alias("section_balance"), percent(F.sum("described"), F.sum("figures")).alias("figure_captioning"), F.flatten(F.collect_list("screens")).alias("screens"),
    )
    n = F.size("screens")
    return totals.withColumn("figure_distinctness", F.when(n >= 2, 100.0 * (n - repeated(F.col("screens"))) / n)).drop("screens")


def long(found: DataFrame) -> DataFrame:
    """(plan_id, ``metric``, ``value``) of the metrics that ``metrics`` gives."""
    return found.select("plan_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 4).alias("value")) for m in WEIGHTS])).alias("m")).select("plan_id", "m.metric", "m.value")


def score(found: DataFrame) -> DataFrame:
    """(plan_id, ``score``): the weighted mean of the metrics that apply."""
    weight = sum((F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    return found.select("plan_id", F.round(total / F.nullif(weight, F.lit(0.0)), 4).alias("score"))


_W = "[\\p{L}\\p{N}_]"


def _defective(t: str) -> str:
    """Whether a stripped title has any of the eleven defects, for the engine that checks."""
    words = f"list_transform(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w : regexp_replace(w, '[\\x{{0617}}-\\x{{064B}}\\x{{064E}}-\\x{{0652}}\\x{{0640}}]', '', 'g')), lambda w : CASE WHEN length(w) > 3 AND w[1] = 'و' THEN substr(w, 2) ELSE w END)"
    runs = lambda n: f"list_transform(range(1, greatest(1, len({words}) - {n - 2})), lambda i : array_to_string(({words})[i : i + {n - 1}], ' '))"
    tile = "(?:[0-9]+|[A-Za-z\\x{0600}-\\x{06FF}]{1,14}\\.\\.\\.[\\x{200E}\\x{200F}]?|[A-Za-z\\x{0600}-\\x{06FF}]{1,4}[\\x{200E}\\x{200F}]?|[\\x{200E}\\x{200F}]|[.&%#@|=\\-])"
    rules = [
        f"length({t}) < {titles.JUDGED} OR length({t}) > {titles.MOST}",
        f"regexp_matches({t}, '^\\s*(?:القسم\\s+\\S+\\s*—\\s*من\\s+[0-9]|المقطع\\s+الزمني\\s+[0-9])')",
        f"regexp_matches({t}, '(?i)(?:https?://|www\\.|\\.com|\\.org|\\.net|\\.sa(?:[^\\p{{L}}\\p{{N}}_]|$)|/{_W}|\\?{_W}+=)')",
        f"regexp_matches({t}, '(?i)(?:Chrome|Firefox|Mozilla|Edge|Safari|Opera)[^\\p{{L}}\\p{{N}}_]*$')",
        f"len(regexp_extract_all({t}, '[©®™$¥§¶|~^*<>{{}}\\[\\]\\\\_=+`]')) / greatest(length({t}), 1) > {titles.JUNK_SHARE}",
        f"regexp_matches({t}, '[»«›‹▾▼⌄]|\\s\\|\\s|(?:^|[^\\p{{L}}\\p{{N}}_])v\\s[A-Z]')",
        f"(contains({t}, '...') AND regexp_matches({t}, '^\\s*{tile}(?:\\s+{tile})*\\s*$'))",
        f"list_max(list_transform({runs(2)}, lambda x : len(list_filter({runs(2)}, lambda y : y = x)))) > {titles.PAIR_REPEATS}",
        f"len(list_distinct({runs(3)})) < len({runs(3)})",
        f"(len({words}) >= {titles.RATIO_WORDS} AND len(list_distinct({words})) / len({words}) < {titles.UNIQUE})",
    ]
    return "(" + " OR ".join(f"coalesce({r}, false)" for r in rules) + ")"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_SQL = f"""
WITH p AS (SELECT *, lead(source_start) OVER (PARTITION BY plan_id ORDER BY block_idx) AS next_start FROM titled_blocks WHERE kind <> 'figure'),
para AS (SELECT plan_id, 100.0 * count(CASE WHEN regexp_matches({_strip('text')}, '[.!?؟…:»"'')\\]]$') OR next_start - source_end >= {PAUSE} THEN 1 END) / count(*) AS flow,
         100.0 * count(CASE WHEN length({_strip('text')}) BETWEEN {SHORT} AND {LONG} THEN 1 END) / count(*) AS balance FROM p GROUP BY plan_id),
sec AS (SELECT plan_id, section_idx, any_value({_strip('section_title')}) AS t, sum(length(text)) AS size FROM titled_blocks GROUP BY plan_id, section_idx),
twin AS (SELECT *, count(*) OVER (PARTITION BY plan_id, regexp_replace(t, '\\s+', ' ', 'g')) AS n FROM sec),
sections AS (SELECT plan_id, 100.0 * count(CASE WHEN t <> '' AND n = 1 AND NOT {_defective('t')} THEN 1 END) / count(*) AS titling,
             CASE WHEN count(nullif(size, 0)) >= 2 THEN greatest(0.0, 100.0 * (1.0 - least(1.0, stddev_pop(nullif(size, 0)) / avg(nullif(size, 0))))) END AS spread FROM twin GROUP BY plan_id),
f AS (SELECT plan_id, block_idx, {_strip('caption')} AS c, {_strip(f"regexp_replace({_strip('caption')}, '\\s*[—-]\\s*[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\\s*$', '')")} AS t, {_strip('ocr_text')} AS ocr FROM titled_blocks WHERE kind = 'figure'),
captions AS (SELECT plan_id, 100.0 * count(CASE WHEN c <> '' AND NOT regexp_matches(c, '^\\s*(?:لقطة\\s+عند|صورة|شكل)\\s*[0-9:—\\-\\s]*$') AND NOT {_defective('t')} THEN 1 END) / count(*) AS captioning FROM f GROUP BY plan_id),
o AS (SELECT * FROM f WHERE ocr <> ''),
same AS (SELECT a.plan_id, a.block_idx, bool_or(b.block_idx IS NOT NULL) AS part FROM o a LEFT JOIN o b ON b.plan_id = a.plan_id AND b.block_idx <> a.block_idx AND contains(b.ocr, a.ocr) GROUP BY a.plan_id, a.block_idx),
likeness AS (SELECT plan_id, CASE WHEN count(*) >= 2 THEN 100.0 * count(CASE WHEN NOT part THEN 1 END) / count(*) END AS apart FROM same GROUP BY plan_id),
m AS (SELECT s.plan_id, flow AS paragraph_flow, balance AS paragraph_balance, titling AS section_titling, spread AS section_balance, captioning AS figure_captioning, apart AS figure_distinctness
      FROM sections s LEFT JOIN para ON para.plan_id = s.plan_id LEFT JOIN captions c ON c.plan_id = s.plan_id LEFT JOIN likeness l ON l.plan_id = s.plan_id)
"""
QUERIES = [
    Built("plan_metrics", "A09", ["titled_blocks"], lambda titled_blocks: long(metrics(titled_blocks)), _SQL + " UNION ALL ".join(f"SELECT plan_id, '{m}' AS metric, round({m}, 4) AS value FROM m" for m in WEIGHTS)),
    Built("plan_score", "A10", ["titled_blocks"], lambda titled_blocks: score(metrics(titled_blocks)), _SQL + f"SELECT plan_id, round(({' + '.join(f'coalesce({m}, 0) * {w}' for m, w in WEIGHTS.items())}) / nullif({' + '.join(f'CASE WHEN {m} IS NULL THEN 0 ELSE {w} END' for m, w in WEIGHTS.items())}, 0), 4) AS score FROM m"),
]
