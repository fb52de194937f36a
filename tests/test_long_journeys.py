"""Steps of logs that are longer than a recorder's limit of steps."""

from kymo.streaming import machines

from .test_queries import play, screen
from .test_state import Cell, Value

LONG = 3 * machines.STEPS


def journey(n):
    return [screen(k, "click", 1000 * k, role="checkbox") for k in range(n)] + [screen(n, "undo"), screen(n + 1, "up", x=99.0), screen(n + 2, "finish")]


def test_a_log_has_all_its_steps():
    out = play(machines.MACHINES["steps"].step, journey(LONG))
    assert [x[:3] for x in out] == [(k, k + 1, "uncheck" if k % 2 else "check") for k in range(LONG - 1)]
    assert out[: machines.STEPS - 1] == play(machines.steps, journey(machines.STEPS))
    assert play(machines.MACHINES["steps"].step, journey(LONG) + [screen(LONG + 3, "enter"), screen(LONG + 4, "finish")])[-1] == (LONG + 3, 1, "submit", None, "button", "a")


def test_an_event_asks_the_store_as_little_in_a_long_log():
    machine = machines.MACHINES["steps"]
    cells = {n: Cell() for n in machine.maps}
    values, maps = {"n": Value()}, {n: machines.StoredMap(cells[n], len(kind.split(","))) for n, kind in machine.maps.items()}
    found = []
    for e in journey(LONG)[:-1]:  # each in a call of its own
        state = machines.Stored(machine, values, maps)
        found += machines.played(machine, state, e)
        state.keep()
    assert not found and len(cells["done"].rows) == LONG - 1 and sum(c.asked for c in cells.values()) < 5 * LONG
    state = machines.Stored(machine, values, maps)
    found += machines.played(machine, state, journey(LONG)[-1])
    state.keep()
    assert found == play(machine.step, journey(LONG)) and not cells["done"].rows


def test_a_long_log_streams_all_its_steps(spark):
    log = spark.createDataFrame([(r, e["seq"], e["at_ms"], e["kind"], e["sx"] if e["seq"] % 7 else None, e["sy"], e["role"], e["app"]) for r, n in ((1, LONG), (2, 5)) for e in journey(n)], "recording_id long, seq long, at_ms long, kind string, sx double, sy double, role string, app string")
    streamed = machines.run_stream(spark, log, lambda source: machines.stateful(source, machines.MACHINES["steps"]))
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(streamed) == key(machines.replay(log, machines.MACHINES["steps"])) and streamed.count() == LONG - 1 + 4
