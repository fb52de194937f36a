"""Stateful streams: timers, long logs of one key, chained operators, updates; each against batch or a stated result."""

import time

import pytest
from pyspark.sql import functions as F

from kymo.streaming import machines, progress

SF = "/root/testdata/sf0.001"
WALLET = "code long, seq long, t long, op string, hold_id double, want_units long, actual_units long"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


#: Logs begin ten days after 1970: a stream's watermark begins there, and what isn't behind it is late.
BASE = 864_000


def logged(spark, events):
    return spark.createDataFrame([(c, k, BASE + t, *more) for c, k, t, *more in events], WALLET)


def wallet_stream(spark, events):
    log = logged(spark, events)
    return log, machines.run_stream(spark, log, lambda source: machines.stateful(source, machines.MACHINES["wallet"]))


def test_a_hold_goes_back_without_a_further_event_of_its_code(spark):
    """Code 1 reserves and is never heard of again; what code 2 does later lets the timer go off."""
    events = [(1, 1, 0, "add", None, 100, 0), (1, 2, 10, "reserve", 7.0, 60, 0), (2, 3, 20, "add", None, 5, 0), (2, 4, 5000, "get", None, 0, 0), (2, 5, 9000, "get", None, 0, 0)]
    log, out = wallet_stream(spark, events)
    found = sorted(((r.code, r.seq, r.op, r.units, r.open_holds) for r in out.collect()), key=str)
    assert (1, 2, "sweep", 100, 0) in found and (1, 2, "reserve", 40, 1) in found and len(found) == 6
    assert rows(out) == rows(machines.replay(log, machines.MACHINES["wallet"], machines.last_watermark(log)))


def test_a_hold_that_is_not_stale_yet_stays(spark):
    log, out = wallet_stream(spark, [(1, 1, 0, "add", None, 100, 0), (1, 2, 10, "reserve", 7.0, 60, 0), (2, 3, 300, "get", None, 0, 0)])
    assert "sweep" not in {r.op for r in out.collect()}


def test_a_settle_behind_its_sweep_charges_what_was_used(spark):
    """Given back at 611, settled at 5000 (charged alone) and once more (nothing); below zero no reserve is granted."""
    events = [(1, 1, 0, "add", None, 100, 0), (1, 2, 10, "reserve", 7.0, 60, 0), (1, 3, 5000, "settle", 7.0, 0, 130), (1, 4, 9000, "settle", 7.0, 0, 130), (1, 5, 9001, "reserve", 8.0, 1, 0)]
    log, out = wallet_stream(spark, events)
    assert sorted((r.seq, r.op, r.done, r.units) for r in out.collect()) == [(1, "add", True, 100), (2, "reserve", True, 40), (2, "sweep", True, 100), (3, "settle", True, -30), (4, "settle", False, -30), (5, "reserve", False, -30)]


def test_ids_of_settled_holds_are_forgotten_in_time():
    state = {}
    play = lambda t, op, **more: [x for x in machines.played(machines.MACHINES["wallet"], state, {"seq": t, "t": t, "op": op, "hold_id": None, "want_units": 0, "actual_units": 0} | more)]
    play(0, "add", want_units=100)
    play(1, "settle", hold_id=1, actual_units=10)
    assert state["settled"] == {"1": 1} and play(2, "settle", hold_id=1, actual_units=10)[-1][2] is False
    list(machines.wallet_due(state, 1 + machines.KEPT))
    assert state["settled"] == {"1": 1}
    list(machines.wallet_due(state, 2 + machines.KEPT))
    assert state["settled"] == {} and state["leaving"] == {}


def test_time_is_linear_in_the_settles_of_one_code():
    """State variables are read entry by entry: ten times the settles take about ten times as long."""

    def took(n):
        state, began = {}, time.process_time()
        for k in range(n):
            for _ in machines.played(machines.MACHINES["wallet"], state, {"seq": k, "t": k // 50, "op": "settle", "hold_id": k, "want_units": 0, "actual_units": 1}):
                pass
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 25 * took(20_000)


def test_many_settles_of_one_code_in_a_stream(spark):
    events = [(1, 0, 0, "add", None, 10_000, 0)] + [(1, k, k // 10, "settle", float(k % 1500), 0, 1) for k in range(1, 3001)]
    log, out = wallet_stream(spark, events)
    assert rows(out) == rows(machines.replay(log, machines.MACHINES["wallet"], machines.last_watermark(log)))
    assert out.filter("op = 'settle' AND done").count() == 1500 and out.agg(F.min("units")).first()[0] == 8500


def test_alerts_once_a_day_of_each_kind(spark):
    day = 86_400
    events = [(5, k, day * (k // 4) + 60 * (k % 4), "settle", float(k), 0, 100) for k in range(12)]
    accounts = spark.createDataFrame([(5, 1, 2000, 2900, 300)], "code long, account int, cap long, balance long, alert_at long")
    log = logged(spark, events)
    batch = machines.spend_alerts(log, accounts)
    got = sorted((r.seq, r.day, r.kind) for r in batch.collect())
    # a charge of 100 units is 300 millionths: 0.8 of the cap is passed by the sixth, the cap by the seventh, the balance's limit by the ninth
    assert got == [(5, "1970-01-12", "cap80"), (6, "1970-01-12", "cap"), (8, "1970-01-13", "balance"), (8, "1970-01-13", "cap")]
    streamed = machines.run_stream(spark, log, lambda source: machines.spend_alerts_of_stream(source, accounts))
    assert rows(streamed) == rows(batch)


def test_an_unusual_hour_is_an_alert_of_its_code(spark):
    accounts = spark.createDataFrame([(5, 1, 0, 10**9, 0), (6, 1, 0, 10**9, 0)], "code long, account int, cap long, balance long, alert_at long")
    log = logged(spark, [(5, 1, 0, "settle", 1.0, 0, 4000), (6, 2, 5, "settle", 2.0, 0, 4000), (5, 3, 3000, "settle", 3.0, 0, 2001), (5, 4, 3100, "settle", 4.0, 0, 1), (5, 5, 7000, "settle", 5.0, 0, 4000)])
    assert [(r.seq, r.kind) for r in machines.spend_alerts(log, accounts).collect()] == [(3, "anomaly:5")]


def test_progress_is_updated_and_ends_as_the_batch(spark):
    segments, announced = progress.sources(spark, SF)
    updates = progress.run(spark, segments, announced, 3).cache()
    final = {r.recording_id: r for r in progress.last(updates).collect()}
    batch = segments.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"), F.round(100 * F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))) / F.max("end_s"), 4).alias("c")).collect()
    assert {r.recording_id: (r.n, r.w, r.c) for r in batch} == {k: (r.segments, r.words, pytest.approx(r.coverage_percent)) for k, r in final.items()}
    assert updates.groupBy("recording_id").count().agg(F.max("count")).first()[0] >= 2
    assert updates.filter("progress_percent < 100").count() > 0
    updates.unpersist()


def test_segments_without_an_announcement_or_too_late_for_it_do_not_count(spark):
    at = lambda s: F.timestamp_seconds(F.lit(BASE + s))
    base = spark.createDataFrame([(1, 1, 0.0, 5.0, 3), (1, 2, 5.0, 9.0, 3), (2, 1, 0.0, 5.0, 3)], "recording_id int, segment_id int, start_s double, end_s double, n_words int")
    segments = base.withColumn("ts", F.when(F.col("segment_id") == 2, at(13 * 3600)).otherwise(at(5)))
    announced = spark.createDataFrame([(1, 10.0)], "recording_id int, duration_s double").withColumn("announced_at", at(0))
    assert [(r.recording_id, r.segments, r.progress_percent) for r in progress.last(progress.run(spark, segments, announced)).collect()] == [(1, 1, 50.0)]
