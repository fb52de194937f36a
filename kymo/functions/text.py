"""Column functions on text; each is a column expression, so it runs inside the table-wide plan that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from .titles import let

# Letters and phrases of the transcripts' language.
TATWEEL = "ـ"
DIACRITICS = "[ً-ْٰ]"
_MARKS = "[ًٌٍَُِّْ]*"
KNOWN_PHRASES = (
    r"ترجمة\s+نانسي\s+قنقر",
    r"(?:لا\s+تنس(?:وا|ى)\s+)?(?:ال)?اشترا?ك(?:وا)?\s+(?:في|ب)\s*القناة(?!\s+(?:ال[ء-ي]+|الخاص|التي|اللي|بتاع|دي|هذه))(?:\s+(?:و\s*)?(?:تفعيل\s+)?(?:زر\s+)?الجرس)?",
    rf"شكر{_MARKS}ا?{_MARKS}\s+(?:لكم\s+)?(?:على|ل)\s*(?:ال|ل)?مشاهدة",
    r"(?i)subtitles\s+by\s+the\s+amara\.org\s+community",
    r"(?:^|\G|(?<=[.،؛!؟]))[^.،؛!؟]*صفحتنا\s+ليصل(?:ك|كم)\s+كل\s+جديد",
)
TRUE, FALSE = ("صح", "صحيح", "نعم", "true", "t", "1"), ("خطأ", "خطا", "غير صحيح", "لا", "false", "f", "0")
_REPEAT = r"(?U)\b(.{4,40}?)(?:\s+\1(?!\w)){2,}"


def nfc(text: Column) -> Column:
    """Composed Unicode, by the library that Spark itself ships."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def normalize_arabic(text: Column, strip_diacritics: bool = False) -> Column:
    """Composed, without stretching marks (and vowel marks), no space before punctuation, single spaces."""
    out = F.replace(nfc(F.coalesce(text, F.lit(""))), F.lit(TATWEEL), F.lit(""))
    if strip_diacritics:
        out = F.regexp_replace(out, DIACRITICS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+([،.؛؟!:])", "$1"), r"(?U)\s+", " "))


def collapse_repeats(text: Column, passes: int = 10) -> Column:
    """A phrase of 4 to 40 characters said three times or more is said once; again until nothing changes.

    Every pass that changes a nested repeat makes it at least three times shorter, so ten settle texts of 4 * 3**10 characters.
    """

    def again(t: Column, left: int) -> Column:
        return let(F.regexp_replace(t, _REPEAT, "$1"), lambda u: F.when(u == t, u).otherwise(again(u, left - 1))) if left else t

    return let(text, lambda t: again(t, passes))


def strip_known_phrases(text: Column) -> Column:
    """Phrases that recognisers make up over silence go, and punctuation that is then alone."""

    def without(t: Column) -> Column:
        for p in KNOWN_PHRASES:
            t = F.regexp_replace(t, f"(?U){p}", " ")
        return t

    def tidy(t: Column) -> Column:
        spaced = F.trim(F.regexp_replace(F.regexp_replace(t, r"(^|\s)[،.؛!؟,]+(?=\s|$)", "$1"), r"(?U)\s+", " "))
        return F.regexp_replace(spaced, "^[ ،,]+|[ ،,]+$", "")

    return let(text, lambda t: let(without(t), lambda out: F.when(out == t, t).otherwise(tidy(out))))


def fold(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "))


def runs(words: Column, n: Column) -> Column:
    """All runs of n words, joined. The words are computed once, not for each run."""
    n = n if isinstance(n, Column) else F.lit(n)
    joined = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return let(F.struct(words.alias("w"), n.alias("n")), lambda s: joined(s["w"], s["n"]))


def strip_prompt_echo(text: Column, prompt: Column, least: int = 4, share: float = 0.7) -> Column:
    """Sentences of which a run of ``least`` words and ``share`` of all words stands in the prompt go."""

    def echoes(words: Column, hay: Column) -> Column:
        n = F.greatest(F.lit(least), F.ceil(F.size(words) * share).cast("int"))
        return F.exists(runs(words, n), lambda run: F.contains(hay, F.concat(F.lit(" "), run, F.lit(" "))))

    def kept(hay: Column) -> Column:
        return F.filter(F.split(text, r"(?<=[.!?؟])\s+"), lambda s: ~let(F.split(fold(s), " "), lambda words: echoes(words, hay)))

    return F.trim(F.array_join(let(F.concat(F.lit(" "), fold(prompt), F.lit(" ")), kept), " "))


def jaccard3(a: Column, b: Column) -> Column:
    """Jaccard of the three-word runs of two texts."""
    x, y = (F.array_distinct(runs(F.split(fold(t), " "), F.lit(3))) for t in (a, b))
    sizes = let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("all")))
    return let(sizes, lambda n: F.try_divide(n["both"], n["all"] - n["both"]))


def shuffled_options(question: Column, options: Column) -> Column:
    """Options in an order that the question fixes; an "all of the above" stays last."""
    anchored = lambda o: F.lower(o).rlike("(all|none) of the above|كل ما سبق")
    keyed = F.transform(F.filter(options, lambda o: ~anchored(o)), lambda o: F.struct(F.xxhash64(fold(question), o).alias("k"), o.alias("o")))
    return F.concat(F.transform(F.array_sort(keyed), lambda s: s["o"]), F.filter(options, anchored))


def true_false(answer: Column) -> Column:
    """An answer as true or false, however it is said; null for what is neither."""
    folded = fold(F.regexp_replace(nfc(F.coalesce(answer, F.lit(""))), "[\u0610-\u061a\u064b-\u065f\u06d6-\u06ed]", ""))
    return F.when(folded.isin(*TRUE), F.lit(TRUE[0])).when(folded.isin(*FALSE), F.lit(FALSE[0]))


def register(spark: SparkSession) -> None:
    """The pure expressions as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kymo_fold(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(t), '(?U)[^\\\\p{L}\\\\p{N}]+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kymo_overlap(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(b, d) - greatest(a, c)) / nullif(least(b - a, d - c), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kymo_half_up(x DOUBLE) RETURNS DOUBLE RETURN floor(x * 10 + 0.5) / 10")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment cleaned: composed, loops folded, made-up phrases and echoes of the first segment gone."""
    s = fixtures.view(spark, sf_dir, "segments")
    first = s.filter("segment_id = 1").select("recording_id", F.col("text_raw").alias("prompt"))
    text = strip_known_phrases(collapse_repeats(normalize_arabic(F.col("text_raw"))))
    out = s.withColumn("text", text).join(first, "recording_id", "left")
    return out.select("recording_id", "segment_id", F.when(F.col("segment_id") == 1, F.col("text")).otherwise(strip_prompt_echo(F.col("text"), F.coalesce("prompt", F.lit("")))).alias("text"))


def _echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring segments by three-word runs."""
    from pyspark.sql import Window

    s = fixtures.view(spark, sf_dir, "segments")
    before = F.lag("text_raw").over(Window.partitionBy("recording_id").orderBy("segment_id"))
    return s.withColumn("before", before).filter("before IS NOT NULL").select("recording_id", "segment_id", F.round(jaccard3(F.col("text_raw"), F.col("before")), 6).alias("likeness"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.view(spark, sf_dir, "plan_blocks")
    options = F.concat(F.slice(F.split("text", " "), 1, 4), F.array(F.lit("All of the above")))
    return b.select("plan_id", "block_idx", F.array_join(shuffled_options(F.col("text"), options), "|").alias("options"))


def queries() -> dict:
    return {"cleaned_transcripts": _cleaned, "segment_likeness": _echo, "shuffled_options": _options}
