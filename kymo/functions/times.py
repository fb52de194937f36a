"""Times and counts as text, and text as times: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of counted things (one, two, three to ten, more), and when time left can be told.
HOURS, MINUTES, SECONDS = ("ساعة", "ساعتان", "ساعات", "ساعة"), ("دقيقة", "دقيقتان", "دقائق", "دقيقة"), ("ثانية", "ثانيتان", "ثوانٍ", "ثانية")
AND = " و"
LEAST_DONE, LEAST_ELAPSED = 0.03, 5.0


def _millis(seconds: Column) -> Column:
    return F.bround(F.abs(seconds) * 1000, 0).cast("long")


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, a sign before negative ones."""
    ms = _millis(seconds)
    text = F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), text)


def display(seconds: Column) -> Column:
    """HH:MM:SS: rounded to milliseconds, then cut."""
    return F.substring_index(timestamp(seconds), ".", 1)


def for_file(seconds: Column) -> Column:
    return F.translate(timestamp(seconds), ":.", "--")


def chapter_stamp(seconds: Column) -> Column:
    """M:SS, from an hour on H:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def srt_stamp(seconds: Column) -> Column:
    return F.translate(timestamp(F.greatest(seconds, F.lit(0.0))), ".", ",")


def seconds_of(text: Column) -> Column:
    """Seconds of H:M:S, M:S or S; null for anything else."""
    parts = F.split(F.regexp_replace(F.trim(text), "^-+", ""), ":")
    value = F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.when(F.trim(text).startswith("-"), -value).otherwise(value))


def counted(n: Column, forms: tuple[str, str, str, str]) -> Column:
    """A number with what it counts: one, two, few (3 to 10 of its last two digits), more."""
    one, two, few, more = forms
    tail = n % 100
    return F.when(n == 1, F.lit(one)).when(n == 2, F.lit(two)).when(tail.between(3, 10), F.concat(n.cast("string"), F.lit(f" {few}"))).otherwise(F.concat(n.cast("string"), F.lit(f" {more}")))


def spoken(seconds: Column) -> Column:
    """A duration in words: hours and minutes, or minutes, or seconds."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when((h > 0) & (m > 0), F.concat(counted(h, HOURS), F.lit(AND), counted(m, MINUTES))).when(h > 0, counted(h, HOURS)).when(m > 0, counted(m, MINUTES)).otherwise(counted(s, SECONDS))


def remaining(elapsed: Column, done: Column) -> Column:
    """Seconds left at the pace so far; null before enough is done."""
    return F.when((done >= LEAST_DONE) & (elapsed >= LEAST_ELAPSED), elapsed * (1 - done) / done)
