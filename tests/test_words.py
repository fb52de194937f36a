"""Operators on words with times: cases of known results, and the queries against SQL."""

import pytest

from kymo.operators import words

SCHEMA = f"recording_id int, segment_id int, start_s double, end_s double, text_raw string, text_clean string, words array<{words.WORD}>"


def steps(start, count, step, text="كلمة"):
    return [(text, start + k * step, start + k * step + 0.8 * step, 0.9) for k in range(count)]


def segments(spark, *rows):
    """Segments of one recording from lists of words."""
    return spark.createDataFrame([(1, k, w[0][1], w[-1][2], t := " ".join(x[0] for x in w), t, w) for k, w in enumerate(rows, 1)], SCHEMA)


def split(spark, *rows, **more):
    return words.split_long(segments(spark, *rows), **more).orderBy("segment_id", "piece").collect()


def test_a_long_segment_is_split_and_no_word_is_lost(spark):
    parts = split(spark, steps(0.0, 40, 1.0), steps(50.0, 60, 0.9))
    assert len(parts) > 4 and all(p.end_s - p.start_s <= words.MAX_PIECE + 1e-6 for p in parts)
    assert [sum(p.n_words for p in parts if p.segment_id == k) for k in (1, 2)] == [40, 60]
    assert " ".join(p.text for p in parts if p.segment_id == 2) == " ".join(["كلمة"] * 60)
    assert all(p.end_s - p.start_s >= words.MIN_SIDE for p in parts)


def test_short_segments_and_natural_pauses_are_left_alone(spark):
    assert len(split(spark, steps(0.0, 5, 1.0))) == 1
    assert len(split(spark, steps(0.0, 5, 0.5) + steps(3.2, 5, 0.5))) == 1


def test_a_silence_splits_a_segment_that_is_short_enough(spark):
    parts = split(spark, steps(0.0, 6, 0.5) + steps(7.0, 6, 0.5))
    assert [(p.start_s, p.end_s) for p in parts] == [(0.0, pytest.approx(2.9)), (7.0, pytest.approx(9.9))]
    assert [p.n_words for p in split(spark, steps(0.0, 3, 0.4) + steps(13.0, 4, 0.4))] == [3, 4]
    assert [p.end_s for p in split(spark, steps(0.0, 10, 1.0) + steps(16.0, 10, 1.0))][0] == pytest.approx(9.8)


def test_a_sentence_end_beats_a_slightly_longer_silence(spark):
    parts = split(spark, steps(0.0, 6, 1.0) + [("انتهت.", 6.0, 6.8, 0.9)] + steps(7.4, 6, 1.0) + steps(14.2, 6, 1.0), most=10.0)
    assert parts[0].text.endswith("انتهت.")


def test_segments_without_words_are_left_alone(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 40.0, "نص طويل", "نص طويل", []), (1, 2, 41.0, 80.0, "x", None, None)], SCHEMA)
    assert [(r.start_s, r.end_s, r.text, r.n_words) for r in words.split_long(df).orderBy("segment_id").collect()] == [(0.0, 40.0, "نص طويل", 0), (41.0, 80.0, "x", 0)]
    assert words.split_long(df.limit(0)).count() == words.cues(df.limit(0)).count() == words.gaps(df.limit(0)).count() == 0


def test_gaps_are_seen_inside_a_long_segment(spark):
    df = segments(spark, steps(1.0, 3, 1.0) + steps(20.0, 3, 1.0), steps(23.0, 2, 1.0))
    found = lambda **more: sorted(tuple(r)[1:] for r in words.gaps(df, **more).collect())
    assert found(least=2.0) == [(3.8, 20.0)]
    assert found(least=1.0) == [(0.0, 1.0), (3.8, 20.0)]
    ends = spark.createDataFrame([(1, 30.0)], "recording_id int, duration_s double")
    assert found(least=2.0, durations=ends) == [(3.8, 20.0), (24.8, 30.0)]


def test_a_segment_over_anothers_silence_hides_it(spark):
    df = segments(spark, steps(0.0, 2, 1.0) + steps(10.0, 2, 1.0), steps(2.0, 16, 0.5))
    assert words.gaps(df, 1.0).count() == 0 and words.gaps(df.filter("segment_id = 1"), 1.0).count() == 1


def test_cues_are_timed_by_words(spark):
    df = segments(spark, steps(0.0, 20, 1.0, "ab"), steps(19.5, 3, 1.0, "cd"), [("x" * 50, 30.0, 31.0, 1.0), ("y" * 50, 31.0, 32.0, 1.0), ("z", 32.0, 38.0, 1.0)])
    out = [(r.start_s, r.end_s, r.text) for r in words.cues(df).orderBy("cue").collect()]
    assert [round(b - a, 1) for a, b, _ in out[:2]] == [7.8, 7.0] and out[0][2] == " ".join(["ab"] * 8)
    assert out[1][0] == out[0][1], "a cue begins where the last word of the one before ended"
    assert out[2][1] == 19.5 and out[3][2] == "cd cd cd", "a cue ends where the next begins"
    assert out[4:] == [(30.0, 32.0, "x" * 50 + " " + "y" * 50), (32.0, 38.0, "z")], "full at 84 letters"


def test_cues_without_words_have_equal_times(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 15.0, "a b c d e f g", None, None), (1, 2, 15.0, 15.1, "end", "", None), (1, 3, 15.1, 16.0, "  ", None, None)], SCHEMA)
    assert [(r.start_s, r.end_s, r.text) for r in words.cues(df).orderBy("cue").collect()] == [(0.0, 5.0, "a b"), (5.0, 10.0, "c d"), (10.0, 15.0, "e f g"), (15.0, 15.7, "end")]


def test_pieces_that_cannot_be_trusted(spark):
    rows = [(1, 2.5, 0.0, 0.0), (2, None, -1.5, None), (3, 1.0, -0.6, 0.7), (4, 1.0, -0.4, 0.9), (5, None, None, None), (6, 2.4, -1.0, 0.6)]
    df = spark.createDataFrame(rows, "segment_id int, compression double, logprob double, no_speech double")
    assert [r.segment_id for r in words.trusted(df).orderBy("segment_id").collect()] == [4, 5, 6]
