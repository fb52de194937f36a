"""Titles and captions as column expressions: what is wrong with one, how one is cleaned, and what stands in where none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from .times import display

# Lengths, shares, patterns, names of the defects, and words of the titles' languages.
LEAST, MOST, JUDGED = 12, 70, 3
UNIQUE, PAIR_REPEATS, RATIO_WORDS, JUNK_SHARE = 0.70, 2, 6, 0.04
DEFECTS = {
    "short": "قصير جدًّا",
    "long": "طويل جدًّا",
    "ordinal": "ترتيبي",
    "url": "مسار إنترنت",
    "browser": "شريط متصفّح",
    "misread": "قراءة فاشلة",
    "menu": "شريط تنقّل",
    "tile": "بطاقة اسم مشارك",
    "loop": "حلقة تكرار",
    "phrase": "عبارة مكرّرة",
    "repeats": "تكرار مفرط",
}
ORDINAL = r"(?U)^\s*(?:القسم\s+\S+\s*—\s*من\s+\d|المقطع\s+الزمني\s+\d)"
URL = r"(?iU)(?:https?://|www\.|\.com|\.org|\.net|\.sa\b|/\w|\?\w+=)"
BROWSER = r"(?iU)(?:Chrome|Firefox|Mozilla|Edge|Safari|Opera)\W*$"
JUNK = r"[©®™$¥§¶|~^*<>{}\[\]\\_=+`]"
MENU = r"(?U)[»«›‹▾▼⌄]|\s\|\s|\bv\s(?=[A-Z])"
_TILE = r"(?:\d+|[A-Za-z؀-ۿ]{1,14}\.\.\.[‎‏]?|[A-Za-z؀-ۿ]{1,4}[‎‏]?|[‎‏]|[.&%#@|=\-])"
TILE = rf"(?U)^(?=.*\.\.\.)\s*{_TILE}(?:\s+{_TILE})*\s*$"
OPENER = (
    r"(?U)^\s*(?:و|ف|ثم|طيب|يعني|أه+|امم+|اه+|ال[أا]ن|هنا|كده|ماشي|"
    r"بسم\s+الله[^.،]*|السلام\s+عليكم[^.،]*|"
    r"وعليكم\s+السلام[^.،]*|أهلا?\s+وسهلا?[^.،]*)\b[\s،]*"
)
VOWELS = r"[ؗ-ًؚ-ْـ]"
SHORT_WORDS = ["a", "an", "of", "to", "in", "on", "at", "is", "it", "as", "by", "or", "am", "pm", "id", "no", "tv", "hr", "q1", "q2", "q3", "q4", "ai", "hq"]
HOLLOW = ["بدون محتوى", "بلا محتوى", "لا يوجد محتوى", "غير محدد", "غير واضح", "فارغ", "بدون عنوان", "بلا عنوان", "مقطع زمني", "no content", "untitled", "unknown"]
DEFAULT = "تفريغ تسجيل"
ORDINALS = ["الأول", "الثاني", "الثالث", "الرابع", "الخامس", "السادس", "السابع", "الثامن", "التاسع", "العاشر", "الحادي عشر", "الثاني عشر"]
GENERIC = r"(?U)^\s*(?:لقطة\s+عند|صورة|شكل)\s*[\d:—\-\s]*$"
STAMP = r"(?U)\s*[—-]\s*\d{1,2}:\d{2}(?::\d{2})?\s*$"
SENTENCE_END = r"(?U)[.!?؟…:»\"')\]]\s*$"
SECTION, SHOT = "القسم {} — من {}", "لقطة عند {}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(text: Column, marks: str = r"\s") -> Column:
    return F.regexp_replace(text, rf"(?U)^[{marks}]+|[{marks}]+$", "")


def any_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _words(text: Column) -> Column:
    """Runs of letters, without vowel marks and a joined "and"."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))
    plain = F.transform(found, lambda w: F.regexp_replace(w, VOWELS, ""))
    return F.transform(plain, lambda w: F.when((F.length(w) > 3) & w.startswith("و"), F.substr(w, F.lit(2))).otherwise(w))


def _runs(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def title_defects(title: Column, least: int = JUDGED) -> Column:
    """The names of what is wrong with a title, in order; none if it will do."""

    def of(t: Column) -> Column:
        def by_words(w: Column) -> Column:
            pairs, triples = _runs(w, 2), _runs(w, 3)
            loop = let(pairs, lambda p: F.exists(F.array_distinct(p), lambda x: F.size(F.filter(p, lambda y: y == x)) > PAIR_REPEATS))
            phrase = F.size(F.array_distinct(triples)) < F.size(triples)
            repeats = (F.size(w) >= RATIO_WORDS) & (F.size(F.array_distinct(w)) / F.size(w) < UNIQUE)
            named = {"loop": loop, "phrase": phrase, "repeats": repeats}
            return F.array_compact(F.array(*[F.when(rule, F.lit(DEFECTS[name])) for name, rule in named.items()]))

        named = {
            "short": F.length(t) < least,
            "long": F.length(t) > MOST,
            "ordinal": t.rlike(ORDINAL),
            "url": t.rlike(URL),
            "browser": t.rlike(BROWSER),
            "misread": F.regexp_count(t, F.lit(JUNK)) / F.greatest(F.length(t), F.lit(1)) > JUNK_SHARE,
            "menu": t.rlike(MENU),
            "tile": t.rlike(TILE),
        }
        return F.concat(F.array_compact(F.array(*[F.when(rule, F.lit(DEFECTS[name])) for name, rule in named.items()])), let(_words(t), by_words))

    return let(stripped(any_text(title)), of)


def strip_openers(text: Column) -> Column:
    """Hollow openings go, one after another, six at most."""
    text = stripped(any_text(text))
    for _ in range(6):
        text = stripped(F.regexp_replace(text, OPENER, ""))
    return text


def strip_fragments(text: Column) -> Column:
    """Up to three broken pieces of words at the end go, while a title's length is left."""

    def once(t: Column) -> Column:
        piece = F.regexp_extract(t, r"(?U)\s+([A-Za-z]{1,3})\s*$", 1)
        rest = stripped(F.regexp_replace(t, r"(?U)\s+[A-Za-z]{1,3}\s*$", ""), r" \-–—،,.")
        return F.when((piece != "") & ~F.lower(piece).isin(SHORT_WORDS) & (F.length(rest) >= LEAST), rest).otherwise(t)

    text = stripped(any_text(text))
    for _ in range(3):
        text = let(text, once)
    return text


def clean_title(text: Column) -> Column:
    """A sentence as a title: openers and fragments gone, judged whole, then cut at a word; empty if it won't do."""
    edge = r" ،؛\-—:"
    candidate = stripped(F.regexp_replace(strip_fragments(strip_openers(text)), r"(?U)\s+", " "), edge)

    def judged(c: Column) -> Column:
        wrong = F.filter(title_defects(c, LEAST), lambda d: d != DEFECTS["long"])
        cut = F.when(F.length(c) > MOST, stripped(F.regexp_replace(F.left(c, F.lit(MOST)), r" [^ ]*$", ""), edge)).otherwise(c)
        return F.when((F.size(wrong) == 0) & (F.length(cut) >= LEAST), cut).otherwise(F.lit(""))

    return let(candidate, judged)


def safe_title(title: Column) -> Column:
    """The title in single spaces; the neutral one for what says nothing."""
    plain = stripped(F.regexp_replace(any_text(title), r"(?U)\s+", " "))
    hollow = lambda t: F.exists(F.array(*map(F.lit, HOLLOW)), lambda h: F.contains(F.lower(t), h))
    return let(plain, lambda t: F.when((F.length(t) < 3) | hollow(t), F.lit(DEFAULT)).otherwise(t))


def is_generic_caption(caption: Column) -> Column:
    """A caption that is only its kind and a number or time, its stamp left aside."""
    return any_text(caption).rlike(GENERIC) | F.regexp_replace(any_text(caption), STAMP, "").rlike(GENERIC)


def ends_sentence(text: Column) -> Column:
    return any_text(text).rlike(SENTENCE_END)


def section_title(place: Column, start_s: Column) -> Column:
    """"Section n, from hh:mm:ss", n in words up to twelve."""
    name = F.coalesce(F.get(F.array(*map(F.lit, ORDINALS)), place - 1), place.cast("string"))
    before, middle, after = SECTION.partition("{}")[0], " — من ", ""
    return F.concat(F.lit(before), name, F.lit(middle), display(start_s), F.lit(after))


def screen_caption(ocr_text: Column, at_s: Column, is_person: Callable[[Column], Column] | None = None) -> Column:
    """The first screen line that makes a title, with its time; else "shot at" its time."""
    lines = F.transform(F.split(any_text(ocr_text), "\n"), clean_title)
    usable = F.filter(lines, lambda t: (t != "") & (~is_person(t) if is_person else F.lit(True)))
    return F.coalesce(F.concat(F.get(usable, F.lit(0)), F.lit(" — "), display(at_s)), F.concat(F.lit(SHOT.format("")), display(at_s)))


def strip_source_fingerprint(name: Column) -> Column:
    """Without the hex fingerprint behind two underscores."""
    return stripped(F.regexp_replace(name, r"(?U)__[0-9a-f]{8,20}\b", ""))


def humanize_title(stem: Column) -> Column:
    """A file's name as a title: separators, recorders' times and technical endings gone; the name itself if nothing is left."""
    edge = r" \-_."

    def of(name: Column) -> Column:
        t = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"(?<=[\p{L}])-(?=[\p{L}])", " ")
        for pattern in (r"(?iU)\s+at\s+\d{1,2}[.:]\d{2}([.:]\d{2})?\s*(AM|PM)?\s*$", r"(?U)[\s-]*\d{4}-\d{2}-\d{2}([\s-]+\d{2}[.:]?\d{2}([.:]?\d{2})?)?\s*$", r"(?U)[\s-]*\d{8}[_-]\d{6}\s*$"):
            t = F.regexp_replace(t, pattern, "")
        t = stripped(F.regexp_replace(t, r"(?U)\s+", " "), edge)
        t = stripped(F.regexp_replace(t, r"(?iU)[\s-]*\b(final|copy|output|export|raw|v\d+)\b\s*$", ""), edge)
        return let(stripped(F.regexp_replace(t, r"(?U)\s+", " "), edge), lambda c: F.when(F.length(c) >= 3, c).otherwise(name))

    return let(strip_source_fingerprint(stem), of)


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title of each section: its first block's text."""
    b = fixtures.view(spark, sf_dir, "plan_blocks")
    return b.groupBy("plan_id", "section_idx").agg(F.min_by("text", "block_idx").alias("title"), F.min("source_start").alias("start_s"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_lines(spark, sf_dir).select("plan_id", "section_idx", F.array_join(title_defects(F.col("title")), "|").alias("defects"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaned title of each section, else its ordinal one."""
    rows = _first_lines(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("section_idx"))
    clean = rows.withColumn("place", place).withColumn("clean", clean_title(F.col("title")))
    return clean.select("plan_id", "section_idx", F.when(F.col("clean") != "", safe_title(F.col("clean"))).otherwise(section_title(F.col("place"), F.col("start_s"))).alias("title"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = fixtures.view(spark, sf_dir, "keyframes")
    captioned = k.select("recording_id", "image_id", screen_caption(F.col("ocr_text"), F.col("ts")).alias("caption"))
    return captioned.withColumn("generic", is_generic_caption(F.col("caption")))


def queries() -> dict:
    return {"title_verdicts": _verdicts, "section_titles": _titles, "figure_captions": _captions}
