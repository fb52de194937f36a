"""Texts of two directions: where each run of one direction begins and ends, and the terms that each script gives.

A run is letters and digits of one direction with the neutral characters behind them: spaces and marks belong to what stands before them. Neutral
characters at the begin of a text are a run of their own, from left to right. The runs of a text, joined, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters written from right to left; letters and digits of other scripts.
RTL = r"֐-׿؀-ۿ܀-ݏݐ-ݿࢠ-ࣿיִ-﷿ﹰ-﻿"
LTR = rf"[\p{{L}}\p{{N}}&&[^{RTL}]]"
# A phrase of Latin words, its least letters; a word of Arabic letters; marks that a folded text is without.
LATIN_PHRASE = r"(?U)\b[A-Za-z][A-Za-z0-9&/+.-]{2,}(?:\s+[A-Z][A-Za-z0-9&/+.-]{1,})*"
PHRASE_CHARS = 5
ARABIC_WORD = r"[ء-ي]{3,}"
DIACRITICS = r"[ؐ-ًؚ-ٰٟۖ-ۭ]"
# Arabic words that make no term.
STOP = (
    "التي الذي الذين هذا هذه ذلك هناك هنا كان كانت يكون تكون على عن في من إلى الى مع بعد قبل بين عند كل بعض غير أيضا أيضًا "
    "يعني طيب تمام ممكن لازم عشان علشان بس دي ده احنا إحنا انت أنت نحن هو هي هم ما لا نعم أن إن أو او ثم حتى لكن قد "
    "الآن اليوم شوية كده كدا خلاص برضه طب انا انتي ازاي ازاى عايز عايزه عايزين اقدر نقدر ننزل ننزّل بدخل ندخل حاجه حاجة اول "
    "اولا ثاني مثلا بتاع بتاعه دلوقتي كمان تاني اعمل نعمل هعمل نشوف شوف علي ايه ليه فين امتي لو اللي الي"
).split()


def runs(text: Column) -> Column:
    """(``text``, ``rtl``) of every run, in order; null and empty texts have none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)([{RTL}](?:(?!{LTR}).)*|{LTR}(?:[^{RTL}])*|(?:(?!{LTR})[^{RTL}])+)"), F.lit(1))
    return F.transform(found, lambda r: F.struct(r.alias("text"), r.rlike(rf"^[{RTL}]").alias("rtl")))


def direction(text: Column) -> Column:
    """Of a paragraph: one character from right to left decides."""
    return F.when(text.rlike(f"[{RTL}]"), F.lit("rtl")).otherwise(F.lit("ltr"))


def folded(text: Column) -> Column:
    """Arabic letters without marks and variants."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    return F.translate(F.regexp_replace(F.regexp_replace(composed, DIACRITICS, ""), "ـ", ""), "أإآٱةى", "ااااهي")


def latin_phrases(text: Column) -> Column:
    """Phrases of Latin words, single spaces between them."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LATIN_PHRASE), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", " "))
    return F.filter(found, lambda p: F.length(p) >= PHRASE_CHARS)


def arabic_pairs(text: Column) -> Column:
    """Neighbouring Arabic words of a folded text, neither of them a stop word."""
    words = F.regexp_extract_all(folded(text), F.lit(ARABIC_WORD), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(F.filter(pairs, lambda p: ~p["a"].isin(STOP) & ~p["b"].isin(STOP)), lambda p: F.concat_ws(" ", p["a"], p["b"]))
