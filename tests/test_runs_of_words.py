"""Runs of words in time that grows with a text, not with its square."""

import random
import time

from pyspark.sql import functions as F

from kymo.functions import text


def likeness(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(text.jaccard3(F.col("a"), F.col("b")).alias("x")).first().x


def test_likeness_of_texts(spark):
    assert likeness(spark, "One two, three four", "one two three  five") == 1 / 3
    assert likeness(spark, "a b c a b c", "a b c") == 1 / 3
    assert likeness(spark, "a b", "c d") is None and likeness(spark, None, "a b c") == 0 and likeness(spark, None, None) is None


def test_long_texts_are_compared_in_time_of_their_length(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    begin = time.monotonic()
    assert likeness(spark, long, long + " more") == (30_000 - 2) / (30_000 - 1)
    assert time.monotonic() - begin < 15  # the text was cut into words again for each run


def test_echoes_in_long_texts_are_found_in_time_of_their_length(spark):
    long = " ".join(f"w{k}" for k in range(10_000))
    df = spark.createDataFrame([(f"{long}. Other words are kept here.", f"so {long} it is")], "t string, p string")
    begin = time.monotonic()
    assert df.select(text.strip_prompt_echo(F.col("t"), F.col("p")).alias("x")).first().x == "Other words are kept here."
    assert time.monotonic() - begin < 12  # sentence and prompt were folded again for each run


def test_nested_repeats_are_folded_as_often_as_asked(spark):
    inner = "abcd " * 3 + "end "
    df = spark.createDataFrame([(inner * 3 + "x",), ("no repeat",), (None,)], "t string")
    clean = lambda n: [r.x for r in df.select(text.collapse_repeats(F.col("t"), n).alias("x")).collect()]
    assert clean(10) == ["abcd end x", "no repeat", None] and clean(0)[0] == inner * 3 + "x"


def test_phrases_go_as_by_a_search_from_each_place(spark):
    rng, last = random.Random(3), "صفحتنا ليصلكم كل جديد"
    texts = [" ".join(rng.choice([last, "صفحتنا", "a", "b.", "؟", "،", "ترجمة نانسي قنقر", "c!d"]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    whole = r"(?U)[^.،؛!؟]*صفحتنا\s+ليصل(?:ك|كم)\s+كل\s+جديد"
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select(F.regexp_replace("t", "(?U)" + text.KNOWN_PHRASES[-1], "-").alias("a"), F.regexp_replace("t", whole, "-").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any("-" in r.a for r in rows)
    long = spark.createDataFrame([("كلمة " * 40_000,)], "t string")
    begin = time.monotonic()
    assert long.select(F.length(text.strip_known_phrases(F.col("t")))).first()[0] == 200_000
    assert time.monotonic() - begin < 12
