"""State of a stream's key: how often the store is asked, and which timers are set."""

from kymo.streaming import machines


class Cell:
    """A map of the store that counts what it is asked."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def _ask(self):
        self.asked += 1

    def getValue(self, k):  # noqa: N802
        self._ask()
        return self.rows.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self._ask()
        self.rows[k] = v

    def removeKey(self, k):  # noqa: N802
        self._ask()
        self.rows.pop(k, None)

    def iterator(self):
        self._ask()
        return iter(list(self.rows.items()))


class Value:
    row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def test_a_call_asks_the_store_little_and_keeps_the_same():
    machine = machines.MACHINES["wallet"]
    events = [{"seq": k, "t": 40 * k, "op": ("add", "reserve", "get", "reserve", "settle")[k % 5], "hold_id": k - k % 5 + 3 if k % 5 == 4 else k, "want_units": 9, "actual_units": 4} for k in range(400)]
    plain: dict = {}
    want = [x for e in events for x in machines.played(machine, plain, e)]
    cells = {n: Cell() for n in machine.maps}
    values, maps = {"units": Value()}, {n: machines.StoredMap(cells[n], len(kind.split(","))) for n, kind in machine.maps.items()}
    found, timers = [], 0
    for part in (events[:250], events[250:]):
        state = machines.Stored(machine, values, maps)
        found += [x for e in part for x in machines.played(machine, state, e)]
        timers += len(set(machine.pending(state)))
        state.keep()
    assert found == want and timers <= 2 * machines.HOLDS
    assert {k[0]: v for k, v in cells["holds"].rows.items()} == plain["holds"] and {k[0]: v[0] for k, v in cells["settled"].rows.items()} == plain["settled"]
    assert sum(c.asked for c in cells.values()) < 2 * len(events)
