"""Names of people on screens, and terms that are no terms: column expressions. Known first names are the caller's list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators.lines import lines as lines_of
from ..operators.lines import words_in_order
from .titles import any_text, let

# Shapes of names, and words of user interfaces.
NAME, LOWER_NAME = r"^[A-Z][A-Za-z'\-]{1,}$", r"^[a-z][a-z'\-]{2,}$"
TRUNCATED = r"^(?:[A-Z][A-Za-z'\-]{1,14}(?:\.{2,}|…)|(?:\.{2,}|…)[A-Za-z'\-]{1,14})$"
SURNAME = r"(?i)^(?:al|el|abu|bin|abd|ibn)[a-z]{3,}$"
MAY_BE_SURNAME = r"(?i)(?<![a-z])(?:al|el|abu|bin|abd|ibn)[a-z]{3}"
MARKS = r"[.,:;()\[\]!|]"
AMBIGUOUS = "asia dana hala nada amal jana mona hayat bayan noor nour reem lama haya".split()
NOT_SURNAMES = """
allow allowed allows also already almost alternate alternative although always altogether alert alerts algebra algorithm album alumni
alphabet alphabetical alignment aligned else elsewhere element elements elective electives electric electronic eligible eligibility
elapsed elementary binary binder binders ibnsina abduct
""".split()
UI_WORDS = """
admin account activity all arabic art assessment assessments attached back boys biology calendar cancel chemistry class classes close
comment comments computer criteria curriculum dashboard day days delete edit education elementary english feedback file filter french
friday geography girls grade group groups help high history holy home instruction islamic kg lesson lessons math mathematics menu met
middle monday month music new next not physical physics plan planned planner pending primary quran reports reset resources saturday
school schools science search section select settings share shared social studies subject sunday support teacher teachers this thursday
timeline today tuesday unit units upload view wednesday week weekly welcome with your year page status total report january february
march april may june july august september october november december sep oct nov dec jan feb mar apr jun jul aug summary details overview
profile logout login sign student students parent parents staff principal department library sports health technology
""".split()
GENERIC_UI = """
start folder folders form forms task tasks staff schedule process assign employee view save submit cancel next back add edit delete filter
filters collapse reset open close support home search menu settings help yes no ok done status type date name select all new update
download upload print share file files page details more show hide
""".split()
CONNECTORS = ["of", "and", "for", "the", "to", "in", "on", "a"]
MOST_WORDS = 4


def _tokens(text: Column) -> Column:
    words = F.filter(F.split(any_text(text), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, _bare)


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, f"^{MARKS}+|{MARKS}+$", "")


def is_truncated(word: Column) -> Column:
    """A display name cut with dots."""
    return word.rlike(TRUNCATED)


def _is_known(word: Column, first_names: Sequence[str]) -> Column:
    return F.lower(word).isin([n.lower() for n in first_names]) if first_names else F.lit(False)


def _is_person(words: Column, first_names: Sequence[str]) -> Column:
    return F.exists(words, lambda w: _is_person_word(w, first_names))


def _is_person_word(word: Column, first_names: Sequence[str]) -> Column:
    return _is_known(word, first_names) | (word.rlike(SURNAME) & ~F.lower(word).isin(NOT_SURNAMES))


def _may_hold_person(text: Column, first_names: Sequence[str]) -> Column:
    """False only for texts of which no word is a person's by ``_is_person``: what is cheap to see of a text before it is cut into words."""
    return F.lit(True) if first_names else text.rlike(MAY_BE_SURNAME)


def is_name_line(words: Column, first_names: Sequence[str] = ()) -> Column:
    """Two to four words shaped like names, none of a user interface, one of them a known first name or shaped like a surname."""
    shaped = F.forall(words, lambda w: (w.rlike(NAME) | w.rlike(LOWER_NAME)) & (F.length(w) >= 3) & ~F.lower(w).isin(UI_WORDS))
    return F.size(words).between(2, 4) & shaped & _is_person(words, first_names)


def looks_like_person_name(text: Column, first_names: Sequence[str] = ()) -> Column:
    """Does a title or caption hold a person's name: a cut display name, a clear first name, or a name of two to four words (P09)?"""

    def of(words: Column) -> Column:
        windows = lambda n: F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: is_name_line(F.slice(words, i, n), first_names))
        clear = F.exists(words, lambda w: w.rlike(NAME) & _is_known(w, first_names) & ~F.lower(w).isin(AMBIGUOUS))
        return _is_person(words, first_names) & (clear | windows(4) | windows(3) | windows(2))

    whole = any_text(text)
    cut = whole.rlike(r"\.\.|…") & F.exists(F.split(whole, r"(?U)\s+"), is_truncated)
    return cut | (_may_hold_person(whole, first_names) & let(_tokens(text), of))


def is_noise_term(term: Column, origin: Column, first_names: Sequence[str] = ()) -> Column:
    """A candidate that is no term: a person, a lone button, a broken reading, a table's head, or buttons alone."""
    screen = origin == "screen"

    def of(words: Column) -> Column:
        last, head = F.element_at(words, -1), F.element_at(words, 1)
        latin = F.filter(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9'&/+.-]*$"))
        broken = (F.size(latin) > 0) & (F.get(latin, F.lit(0)).rlike(r"^[a-z][a-z'-]*$") | (last.rlike("^[a-z]{1,3}$") & ~last.isin(CONNECTORS)))
        lone = (F.size(words) == 1) & (F.lower(head).isin(GENERIC_UI) | (screen & head.rlike(r"^[a-z][a-z\-]*$")))
        return lone | (screen & (F.size(words) > MOST_WORDS)) | (screen & broken) | F.forall(words, lambda w: F.lower(w).isin(GENERIC_UI))

    words = F.filter(F.split(any_text(term), r"(?U)\s+"), lambda w: w != "")
    return (F.size(words) == 0) | looks_like_person_name(term, first_names) | F.when(F.size(words) > 0, let(words, of)).otherwise(F.lit(True))


def name_spans(words: DataFrame, first_names: Sequence[str] = ()) -> DataFrame:
    """Names in the lines of screen words (image_id, line, word_idx, text): first and last place, and the name.

    From left to right, the longest window of four, three or two words that is a name, carried on over neighbours that are
    shaped like names; words of one name are in no other. Cut display names stand alone or with a neighbour.
    """
    may_begin = (F.col("text").rlike(r"\.\.|…") & is_truncated(F.trim("text"))) | (_may_hold_person(F.col("text"), first_names) & _is_person_word(_bare(F.col("text")), first_names))  # a line without such a word holds no name
    lines = lines_of(words, hit=may_begin).filter("hit").withColumn("w", words_in_order(F.col("runs")))
    lines = lines.select("image_id", "line", F.transform("w", lambda x: x["word_idx"].cast(words.schema["word_idx"].dataType)).alias("at"), F.transform("w", lambda x: _bare(x["text"])).alias("t"), F.transform("w", lambda x: is_truncated(F.trim(x["text"]))).alias("cut"))
    like = F.transform("t", lambda w: (w.rlike(NAME) | w.rlike(LOWER_NAME)) & (F.length(w) >= 3) & ~F.lower(w).isin(UI_WORDS))
    lines = lines.withColumn("like", like).withColumn("n", F.size("t"))
    span = "struct<a: int, z: int>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{span}>").alias("found"))

    def step(s: Column, i: Column) -> Column:
        size = F.coalesce(*[F.when((i + n <= F.col("n")) & is_name_line(F.slice(F.col("t"), i + 1, n), first_names), F.lit(n)) for n in (4, 3, 2)])

        def grown(n: Column) -> Column:
            before = F.when(i > 0, F.array_max(F.filter(F.sequence(F.lit(0), i - 1), lambda p: ~F.get("like", p) | (p < s["next"]))))
            after = F.when(i + n < F.col("n"), F.array_min(F.filter(F.sequence(i + n, F.col("n") - 1), lambda p: ~F.get("like", p))))
            a, z = F.coalesce(before + 1, F.lit(0)), F.coalesce(after, F.col("n"))
            return F.struct(z.cast("int").alias("next"), F.concat(s["found"], F.array(F.struct(a.cast("int").alias("a"), (z - 1).cast("int").alias("z")))).alias("found"))

        neighbour = F.when((i + 1 < F.col("n")) & F.get("t", i + 1).rlike(NAME) & ~F.lower(F.get("t", i + 1)).isin(UI_WORDS), i + 1).otherwise(i)
        alone = F.struct((neighbour + 1).cast("int").alias("next"), F.concat(s["found"], F.array(F.struct(i.cast("int").alias("a"), neighbour.cast("int").alias("z")))).alias("found"))
        return F.when(i < s["next"], s).when(F.get("cut", i), alone).otherwise(let(F.struct(size.alias("n")), lambda x: F.when(x["n"].isNull(), s).otherwise(grown(x["n"]))))

    found = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, step, lambda s: s["found"])
    spans = lines.select("image_id", "line", "at", "t", F.explode(found).alias("s"))
    return spans.select("image_id", "line", F.get("at", F.col("s.a")).alias("first_word"), F.get("at", F.col("s.z")).alias("last_word"), F.array_join(F.slice("t", F.col("s.a") + 1, F.col("s.z") - F.col("s.a") + 1), " ").alias("name"))


def queries() -> dict:
    blocks = lambda s, d: fixtures.view(s, d, "plan_blocks")
    return {
        "person_spans": lambda s, d: name_spans(fixtures.view(s, d, "ocr_words")),
        "person_lines": lambda s, d: blocks(s, d).groupBy("plan_id").agg(F.count_if(looks_like_person_name(F.col("text"))).alias("named"), F.count(F.lit(1)).alias("blocks")),
        "noise_verdicts": lambda s, d: blocks(s, d).select("plan_id", "block_idx", is_noise_term(F.substring_index("text", " ", 3), F.lit("screen")).alias("noise")),
    }
