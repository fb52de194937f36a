"""Stateful operators over event logs: one small state machine for each key, run in batch or as a stream.

A machine takes its state and one event and gives output rows; ``due`` gives what falls due by a time. In batch, ``replay`` folds
each key's events in order of ``seq``. As a stream, ``stateful`` keeps the state as state variables (single values and maps, read and written
entry by entry) with event-time timers, so that what falls due comes without a further event of its key. Both give the same rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixtures
from ..sources.shared import shared_dir

# Fixed values of the ledgers: seconds after which a hold is given back, holds at once, seconds of an hour window, of a report.
STALE, HOLDS, HOUR, REPORT = 600, 3, 3600, 21_600
DEVICES, MOVES = 2, 3
DOUBLE_MS, DOUBLE_PX, DRAG_PX, STEPS = 500, 6.0, 24.0, 200
FIELDS = ("textbox", "searchbox", "combobox", "cell")
ACTIONS = {"click": "click", "type": "type", "enter": "submit", "shortcut": "submit"}
#: Share of a cap from which its alert warns; millionths of a dollar for a unit; units of an hour that are unusual.
NEARLY, PRICE, ANOMALY = 0.8, 3, 6000
#: Seconds for which the id of a settled hold is known, and by which events may be late (that much behind, timers go off).
KEPT, DELAY = 30 * 86_400, 600


def swept(state: dict, t: int) -> Iterator[tuple]:
    """Holds that are stale at ``t`` go back to the balance, oldest first: a row for each, with the ``seq`` of its reserve."""
    holds = state.setdefault("holds", {})
    for k, (_, take, seq) in sorted((x for x in holds.items() if t - x[1][0] > STALE), key=lambda x: x[1]):
        holds.pop(k)
        state["units"] = state.get("units", 0) + take
        yield seq, "sweep", True, state["units"], len(holds)


def forgotten(state: dict, t: int) -> None:
    """Drop the ids of holds whose time to be known ends at ``t``."""
    for name in state.setdefault("leaving", {}).pop(str(t), "").split():
        state.setdefault("settled", {}).pop(name, None)


def wallet(state: dict, e: dict) -> Iterator[tuple]:
    """Add, reserve and settle against a balance. Stale holds go back first; a late settle charges what was used, below zero if need be; a second settle within ``KEPT`` seconds is nothing."""
    for _ in swept(state, e["t"]):
        pass
    units, holds, settled, leaving = state.get("units", 0), state.setdefault("holds", {}), state.setdefault("settled", {}), state.setdefault("leaving", {})
    done, name = True, str(e["hold_id"])
    if e["op"] == "add":
        units += e["want_units"]
    elif e["op"] == "reserve":
        done = units > 0 and len(holds) < HOLDS
        if done:
            take = min(max(1, e["want_units"]), units)
            holds[name] = (e["t"], take, e["seq"])
            units -= take
    elif e["op"] == "settle":
        before = settled.get(name)
        done = e["hold_id"] is not None and (before is None or e["t"] - before > KEPT)
        if done:
            units += holds.pop(name, (0, 0, 0))[1] - e["actual_units"]
            settled[name] = e["t"]
            at = str(e["t"] + KEPT + 1)
            leaving[at] = f"{leaving.get(at, '')} {name}"
    state["units"] = units
    yield e["seq"], e["op"], done, units, len(holds)


def wallet_timers(e: dict) -> list[int]:
    """When the id of an event's hold may be forgotten."""
    return [e["t"] + KEPT + 1] if e["op"] == "settle" else []


def wallet_pending(state: dict) -> list[int]:
    """When the holds that are open now are stale: one that is refused, settled or given back needs no timer."""
    return [t + STALE + 1 for _, (t, _, _) in state["holds"].items()]


def wallet_due(state: dict, t: int) -> Iterator[tuple]:
    yield from swept(state, t)
    forgotten(state, t)


def _hour(state: dict, e: dict) -> int:
    """Units since the first event of an hour that begins with an event."""
    if state.get("start") is None or e["t"] - state["start"] > HOUR:
        state["start"], state["units"] = e["t"], 0
    state["units"] += e["actual_units"]
    return state["units"]


def hourly(state: dict, e: dict) -> Iterator[tuple]:
    """Units of an anchored hour; more than the limit is an anomaly."""
    units = _hour(state, e)
    yield e["seq"], units, units > ANOMALY


def spending(state: dict, e: dict) -> Iterator[tuple]:
    """A charge with its account's terms, and the units of its code's hour (X05 before X06)."""
    yield e["seq"], e["t"], e["ts"], e["account"], e["cap"], e["balance"], e["alert_at"], e["actual_units"] * PRICE, _hour(state, e)


def alerts(state: dict, e: dict) -> Iterator[tuple]:
    """Charges against an account's balance and monthly cap; an alert of each kind once a day."""
    months, sent = state.setdefault("months", {}), state.setdefault("sent", {})
    day = f"{e['ts']:%Y-%m-%d}"
    month = months[day[:7]] = months.get(day[:7], 0) + e["cost"]
    left = state["left"] = state.get("left", e["balance"]) - e["cost"]
    kinds = ["balance"] if left <= e["alert_at"] else []
    if e["cap"] > 0 and month >= NEARLY * e["cap"]:
        kinds.append("cap" if month >= e["cap"] else "cap80")
    if e["hour_units"] > ANOMALY:
        kinds.append(f"anomaly:{e['code']}")
    for kind in kinds:
        if sent.get(kind) != day:
            sent[kind] = day
            yield e["seq"], day, kind, month, left


def licence(state: dict, e: dict) -> Iterator[tuple]:
    """The first devices own a code; a term begins with the first activation; revoking sticks; a reset frees devices; a move keeps the place."""
    devices = state.setdefault("devices", [])
    device, verdict = e["device"], "ok"
    if state.get("revoked"):
        verdict = "revoked"
    elif e["op"] == "activate":
        if device not in devices and len(devices) >= DEVICES:
            verdict = "device_limit"
        elif device not in devices:
            devices.append(device)
            state.setdefault("since", e["t"])
    elif e["op"] == "move" and devices:
        if state.get("moves", 0) >= MOVES:
            verdict = "move_limit"
        elif device not in devices:
            devices[0], state["moves"] = device, state.get("moves", 0) + 1
    elif e["op"] == "reset":
        devices.clear()
    elif e["op"] == "revoke":
        state["revoked"] = True
    yield e["seq"], verdict, len(devices), state.get("since")


def throttle(state: dict, e: dict) -> Iterator[tuple]:
    """One report of a device in REPORT seconds; a forced one always goes."""
    sent = e["forced"] or e["t"] - state.get("last", -REPORT) >= REPORT
    if sent:
        state["last"] = e["t"]
    yield e["seq"], sent


def steps(state: dict, e: dict, most: int | None = STEPS) -> Iterator[tuple]:
    """Screen events to steps, given when a recording is finished.

    A second press nearby soon after is a double press, a far release a drag, a press in a field and typing one step; an
    undo takes the last step back. Events after ``most`` steps add none, as in a recorder; None: all count (``all_steps``).
    A step is an entry of the state by its number, so an event reads and writes the last one, however many there are.
    """
    done, n = state.setdefault("done", {}), state.get("n", 0)
    kind = e["kind"]
    if kind == "finish":
        for k, s in sorted(((int(k), s) for k, s in done.items()), key=lambda x: x[0]):
            yield s[0], k, s[1], s[2], s[6], s[7]
            done.pop(str(k))
        state["n"] = 0
        return
    seq, action, gesture, at_ms, sx, sy, role, app = (done.get(str(n)) if n else None) or (None,) * 8
    far = ((e["sx"] - sx) ** 2 + (e["sy"] - sy) ** 2) ** 0.5 if n and e["sx"] is not None and sx is not None else 0.0
    plain = n > 0 and gesture is None
    if kind == "undo":
        if n:
            done.pop(str(n))
            state["n"] = n - 1
    elif kind == "up":
        if plain and action == "click" and far > DRAG_PX:
            done[str(n)] = (seq, action, "drag", at_ms, sx, sy, role, app)
    elif kind == "click" and plain and action in ("click", "check", "uncheck") and 0 <= e["at_ms"] - at_ms <= DOUBLE_MS and far <= DOUBLE_PX:
        done[str(n)] = (seq, "click", "double", at_ms, sx, sy, role, app)
    elif kind == "type" and plain and action == "click" and role in FIELDS:
        done[str(n)] = (seq, "type", gesture, at_ms, sx, sy, role, app)
    elif kind in ACTIONS and (most is None or n < most):
        action = ACTIONS[kind]
        if kind == "click" and e["role"] in ("checkbox", "switch"):
            checked = state.setdefault("checked", {})
            place = f"{e['app']}/{e['role']}"
            checked[place] = on = not checked.get(place, False)
            action = "check" if on else "uncheck"
        state["n"] = n + 1
        done[str(n + 1)] = (e["seq"], action, None, e["at_ms"], e["sx"], e["sy"], e["role"], e["app"])


def all_steps(state: dict, e: dict) -> Iterator[tuple]:
    """Steps of logs of any length."""
    return steps(state, e, None)


@dataclass(frozen=True)
class Machine:
    """A machine: its key, the columns it gives, its state variables (``json``: a short list or map kept as text), and what it does at timers."""

    step: Callable[[dict, dict], Iterator[tuple]]
    key: str
    gives: str
    values: dict[str, str] = field(default_factory=dict)
    maps: dict[str, str] = field(default_factory=dict)
    timers: Callable[[dict], list[int]] = lambda e: []
    pending: Callable[[dict], list[int]] = lambda state: []
    due: Callable[[dict, int], Iterator[tuple]] = lambda state, t: iter(())
    at: str | None = None  # the column of event time among what it gives, for a machine behind it

    @property
    def columns(self) -> list[str]:
        return [self.key, *(x.split()[0] for x in self.gives.split(", "))]


MACHINES: dict[str, Machine] = {
    "wallet": Machine(
        wallet, "code", "seq long, op string, done boolean, units long, open_holds int", {"units": "long"},
        {"holds": "t long, take long, seq long", "settled": "t long", "leaving": "names string"}, wallet_timers, wallet_pending, wallet_due,
    ),
    "hourly": Machine(hourly, "code", "seq long, units long, anomaly boolean", {"start": "long", "units": "long"}),
    "licence": Machine(licence, "code", "seq long, verdict string, devices int, since long", {"devices": "json", "since": "long", "moves": "long", "revoked": "boolean"}),
    "throttle": Machine(throttle, "device_id", "seq long, sent boolean", {"last": "long"}),
    "steps": Machine(
        all_steps, "recording_id", "seq long, step int, action string, gesture string, role string, app string", {"n": "long"},
        {"done": "seq long, action string, gesture string, at_ms long, sx double, sy double, role string, app string", "checked": "is_on boolean"},
    ),
}
#: Machines of the spend alerts, one behind the other.
SPENDING = Machine(spending, "code", "seq long, t long, ts timestamp, account int, cap long, balance long, alert_at long, cost long, hour_units long", {"start": "long", "units": "long"}, at="ts")
ALERTS = Machine(alerts, "account", "seq long, day string, kind string, month_micros long, left_micros long", {"left": "long"}, {"months": "cost long", "sent": "day string"})


class StoredMap:
    """A map of the state as a dictionary whose values are plain, or tuples. Of one call for a key, entries that are asked for
    are read once, and those that have changed are written once, by ``keep``: each access of the store is a message to another process.
    """

    def __init__(self, cell, width: int):
        self.cell, self.width = cell, width
        self.fresh()

    def fresh(self) -> StoredMap:
        """Nothing is known of the entries of the key that comes next."""
        self.held, self.stored, self.changed, self.whole = {}, set(), set(), False
        return self

    def _know(self, k: str, value: tuple) -> None:
        self.stored.add(k)
        self.held.setdefault(k, value[0] if self.width == 1 else tuple(value))

    def __setitem__(self, k: str, value) -> None:
        self.held[k] = value
        self.changed.add(k)

    def get(self, k: str, default=None):
        if k not in self.held and not self.whole:
            found = self.cell.getValue((k,))
            self.held[k] = None
            if found is not None:
                del self.held[k]
                self._know(k, found)
        found = self.held.get(k)
        return default if found is None else found

    def pop(self, k: str, default=None):
        found = self.get(k, default)
        self[k] = None
        return found

    def items(self) -> list[tuple]:
        if not self.whole:
            for k, v in self.cell.iterator():
                self._know(k[0], v)
            self.whole = True
        return [(k, v) for k, v in self.held.items() if v is not None]

    def __len__(self) -> int:
        return len(self.items())

    def keep(self) -> None:
        for k in self.changed:
            if (v := self.held[k]) is not None:
                self.cell.updateValue((k,), (v,) if self.width == 1 else tuple(v))
            elif k in self.stored:
                self.cell.removeKey((k,))


class Stored:
    """State variables of one key, as the dictionary that machines work on. Values are read once and written by ``keep``."""

    def __init__(self, machine: Machine, values: dict, maps: dict):
        self.kinds, self.values, self.maps, self.held = machine.values, values, {n: m.fresh() for n, m in maps.items()}, {}

    def get(self, name: str, default=None):
        if name not in self.held:
            found = self.values[name].get()
            self.held[name] = None if found is None else json.loads(found[0]) if self.kinds[name] == "json" else found[0]
        return default if self.held[name] is None else self.held[name]

    def __getitem__(self, name: str):
        return self.maps[name] if name in self.maps else self.get(name)

    def __setitem__(self, name: str, value) -> None:
        self.held[name] = value

    def setdefault(self, name: str, default):
        if name in self.maps:
            return self.maps[name]
        self.held[name] = self.get(name, default)
        return self.held[name]

    def keep(self) -> None:
        for name, value in self.held.items():
            if value is not None:
                self.values[name].update((json.dumps(value) if self.kinds[name] == "json" else value,))
        for stored in self.maps.values():
            stored.keep()


class Keeper(StatefulProcessor):
    """A machine over a stream."""

    def __init__(self, machine: Machine, timed: bool):
        self.machine, self.timed = machine, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, m = handle, self.machine
        self.values = {n: handle.getValueState(n, f"v {'string' if kind == 'json' else kind}") for n, kind in m.values.items()}
        self.maps = {n: StoredMap(handle.getMapState(n, "k string", kind), len(kind.split(","))) for n, kind in m.maps.items()}

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.machine.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = Stored(self.machine, self.values, self.maps), []
        timers = set()
        parts = list(rows)
        for e in _clean(parts[0] if len(parts) == 1 else pd.concat(parts)):
            out += played(self.machine, state, e)
            timers.update(self.machine.timers(e))
        timers.update(self.machine.pending(state))
        state.keep()
        for t in timers:
            self.handle.registerTimer(t * 1000)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = Stored(self.machine, self.values, self.maps)
        out = list(self.machine.due(state, expiredTimerInfo.getExpiryTimeInMs() // 1000))
        state.keep()
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def played(machine: Machine, state: dict, e: dict) -> Iterator[tuple]:
    """What falls due before an event, then what it gives."""
    if "t" in e:
        yield from machine.due(state, e["t"])
    yield from machine.step(state, e)


def _clean(rows: pd.DataFrame) -> list[dict]:
    return sorted(_plain(rows.columns, [rows[c].astype(object).tolist() for c in rows.columns]), key=lambda e: e["seq"])


def _plain(names: Iterable[str], columns: list[list]) -> Iterator[dict]:
    """Events as dictionaries: no number is null, and a hold's id is whole."""
    columns = [[None if v is None or v != v else int(v) if c == "hold_id" else v for v in column] for c, column in zip(names, columns, strict=True)]
    return (dict(zip(names, e, strict=True)) for e in zip(*columns, strict=True))


def replay(events: DataFrame, machine: Machine, until: int | None = None) -> DataFrame:
    """A machine over a whole log; ``until``: the second up to which timers have gone off.

    Events are dealt by key and sorted, and a task walks over them with the state of one key at a time, so memory is that of a state.
    """
    given = f"{machine.key} {dict(events.dtypes)[machine.key]}, {machine.gives}"
    arrow = to_arrow_schema(T.StructType.fromDDL(given))

    def frame(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        ended = lambda: [(key, *x) for x in machine.due(state, until)] if state is not None and until is not None else []
        for batch in batches:
            out: list[tuple] = []
            for e in _plain(batch.schema.names, [c.to_pylist() for c in batch.columns]):
                if state is None or e[machine.key] != key:
                    out += ended()
                    key, state = e[machine.key], {}
                out += [(key, *x) for x in played(machine, state, e)]
            if out:
                yield frame(out)
        if out := ended():
            yield frame(out)

    return events.repartition(machine.key).sortWithinPartitions(machine.key, F.col("seq").asc_nulls_last()).mapInArrow(run, given)


def last_watermark(log: DataFrame, delay: int = DELAY) -> int | None:
    """The second to which timers have gone off when a stream has read all of a log."""
    last = log.agg(F.max("t")).first()[0] if "t" in log.columns else None
    return None if last is None else last - delay


def stateful(events: DataFrame, machine: Machine, delay: int = DELAY) -> DataFrame:
    """A machine over a stream; each micro-batch's events of a key are taken in order of ``seq``. Needs the RocksDB state store."""
    timed = "t" in events.columns
    if timed and "ts" not in events.columns:
        events = events.withColumn("ts", F.timestamp_seconds("t"))
    if timed and machine is not ALERTS:
        events = events.withWatermark("ts", f"{delay} seconds")
    return events.groupBy(machine.key).transformWithStateInPandas(
        Keeper(machine, timed), f"{machine.key} {dict(events.dtypes)[machine.key]}, {machine.gives}", "Append", "EventTime" if timed else "None", eventTimeColumnName=machine.at or ""
    )


def run_stream(spark: SparkSession, log: DataFrame, transform: Callable[[DataFrame], DataFrame], order: str = "seq", mode: str = "append") -> DataFrame:
    """Deal a log out in two parts, run a stream over the first, start it again from its checkpoint over the second, and give what its sink has.

    So every stream here carries its state from one micro-batch, and from one run, to the next.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    middle = log.approxQuantile(order, [0.5], 0.01)[0] if log.head(1) else 0
    sink = lambda rows, batch: rows.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")
    for part in (log.filter(F.col(order) <= middle), log.filter(F.col(order) > middle)):
        part.write.mode("append").parquet(f"{folder}/in")
        out = transform(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
        query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(_with_batch(out)).parquet(f"{folder}/out")
    if mode == "complete":
        found = found.filter(F.col("_batch") == found.agg(F.max("_batch")).first()[0])
    found = found.drop("_batch")
    found._kymo_folder = folder
    return found


def _with_batch(out: DataFrame):
    return T.StructType([*out.schema, T.StructField("_batch", T.LongType())])


def logs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The event log of a machine, from the given tables."""
    seconds = F.unix_timestamp("ts").alias("t")
    if name in ("wallet", "hourly"):
        return fixtures.view(spark, sf_dir, "wallet_events").select("code", "seq", seconds, "op", F.col("hold_id").cast("double").alias("hold_id"), "want_units", F.col("actual_units").cast("long").alias("actual_units"))
    if name == "steps":  # some events take the last step back; each recording ends with a finish
        seen = fixtures.view(spark, sf_dir, "screen_events")
        seen = seen.withColumn("kind", F.when(F.col("seq") % 29 == 0, "undo").otherwise(F.col("kind")))
        ends = seen.groupBy("recording_id").agg((F.max("seq") + 1).alias("seq"), F.max("at_ms").alias("at_ms")).withColumn("kind", F.lit("finish"))
        return seen.unionByName(ends, allowMissingColumns=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if name == "throttle":
        return events.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), seconds, (F.col("event_type") == "error").alias("forced"))
    op = F.when(F.col("event_type") == "signup", "activate").when(F.col("event_type") == "view", "move").when(F.col("event_type") == "purchase", "reset").when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "revoke").otherwise("check")
    return events.select(F.col("user_id").alias("code"), F.col("event_id").alias("seq"), seconds, op.alias("op"), (F.col("event_id") % 5).alias("device"))


def _windows(source: DataFrame) -> DataFrame:
    counted = source.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("date").cast("string").alias("day"), "events", F.round("total", 2).alias("total"))


def _sessions(source: DataFrame) -> DataFrame:
    s = source.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "events")


def _status(source: DataFrame) -> DataFrame:
    return source.groupBy((F.col("event_id") % 300).alias("job")).agg(F.max_by("event_type", "event_id").alias("last_type"), F.count(F.lit(1)).alias("events"))


def charges(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Settled charges with the terms of their code's account: a stream or a log against a static table."""
    return events.filter("op = 'settle'").join(accounts, "code").withColumn("ts", F.timestamp_seconds("t"))


def spend_alerts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Alerts of a whole log."""
    return replay(replay(charges(events, accounts), SPENDING), ALERTS)


def spend_alerts_of_stream(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Alerts of a stream: the hours of the codes, and behind them the accounts."""
    return stateful(stateful(charges(events, accounts), SPENDING), ALERTS)


def queries() -> dict:
    def machine(name: str, streamed: bool):
        def run(s: SparkSession, d: str) -> DataFrame:
            log = logs(s, d, name)
            return run_stream(s, log, lambda source: stateful(source, MACHINES[name])) if streamed else replay(log, MACHINES[name], last_watermark(log))

        return run

    def accounts(s: SparkSession, d: str) -> DataFrame:
        return fixtures.view(s, d, "accounts")

    events = lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    built = {
        "usage_windows_stream": (_windows, "complete"),
        "activity_sessions_stream": (_sessions, "complete"),
        "job_status_stream": (_status, "complete"),
    }
    return (
        {f"{name}_batch": machine(name, False) for name in MACHINES}
        | {f"{name}_stream": machine(name, True) for name in MACHINES}
        | {name: (lambda s, d, f=f, mode=mode: run_stream(s, events(s, d).select("event_id", "ts", "user_id", "event_type", "value"), f, "event_id", mode)) for name, (f, mode) in built.items()}
        | {"spend_alerts_batch": lambda s, d: spend_alerts(logs(s, d, "wallet"), accounts(s, d))}
        | {"spend_alerts_stream": lambda s, d: run_stream(s, logs(s, d, "wallet"), lambda source: spend_alerts_of_stream(source, accounts(s, d)))}
    )


def oracle_sql() -> dict[str, str]:
    alerts_sql = _with_views(["wallet_events", "accounts"], ALERTS_SQL)
    return {
        "spend_alerts_batch": alerts_sql,
        "spend_alerts_stream": alerts_sql,
        "usage_windows_stream": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY CAST(ts AS DATE)",
        "activity_sessions_stream": """
WITH f AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 6 * 3600 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS events FROM s GROUP BY user_id, n""",
        "job_status_stream": "SELECT event_id % 300 AS job, max_by(event_type, event_id) AS last_type, count(*) AS events FROM events GROUP BY event_id % 300",
    }


def _with_views(names: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({fixtures.DUCK[n]})" for n in names) + ",\n" + body


#: Running sums and the anchored hours of codes, without a machine.
ALERTS_SQL = f"""
e AS (SELECT w.code, seq, ts, CAST(floor(epoch(ts)) AS BIGINT) AS t, actual_units AS units, actual_units * {PRICE} AS cost, account, cap, balance, alert_at,
             row_number() OVER (PARTITION BY w.code ORDER BY seq) AS k FROM wallet_events w JOIN accounts a ON a.code = w.code WHERE op = 'settle'),
h(code, k, t, start, hour_units) AS (SELECT code, k, t, t, units FROM e WHERE k = 1
  UNION ALL SELECT e.code, e.k, e.t, CASE WHEN e.t - h.start > {HOUR} THEN e.t ELSE h.start END, CASE WHEN e.t - h.start > {HOUR} THEN e.units ELSE h.hour_units + e.units END FROM h JOIN e ON e.code = h.code AND e.k = h.k + 1),
r AS (SELECT e.*, hour_units, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(cost) OVER (PARTITION BY account, strftime(ts, '%Y-%m') ORDER BY seq) AS BIGINT) AS month_micros,
             CAST(balance - sum(cost) OVER (PARTITION BY account ORDER BY seq) AS BIGINT) AS left_micros FROM e JOIN h ON h.code = e.code AND h.k = e.k),
a AS (SELECT *, 'balance' AS kind FROM r WHERE left_micros <= alert_at
      UNION ALL SELECT *, 'cap' FROM r WHERE cap > 0 AND month_micros >= cap
      UNION ALL SELECT *, 'cap80' FROM r WHERE cap > 0 AND month_micros >= {NEARLY} * cap AND month_micros < cap
      UNION ALL SELECT *, 'anomaly:' || code FROM r WHERE hour_units > {ANOMALY})
SELECT account, min(seq) AS seq, day, kind, min_by(month_micros, seq) AS month_micros, min_by(left_micros, seq) AS left_micros FROM a GROUP BY account, day, kind
"""
