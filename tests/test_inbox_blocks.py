"""Answers to a block's inbox records at once, against a loop over single records; few calls to the state for many records."""

import random
from types import SimpleNamespace

import pandas as pd

from ledgerloom.streaming import inbox_clock

MS = 86_400_000


class Handle:
    """The state and timers of one block, and how often they were called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.called(self.value is not None), get=lambda: self.called(self.value), update=lambda x: self.called(setattr(self, "value", x)), clear=lambda: self.called(setattr(self, "value", None)))

    def registerTimer(self, t):  # noqa: N802
        self.called(self.timers.add(t))

    def deleteTimer(self, t):  # noqa: N802
        self.called(self.timers.remove(t))

    def listTimers(self):  # noqa: N802
        return iter(self.called(list(self.timers)))


def run(batches):
    """Outcomes of batches of (events, watermark in days), each batch's timers after its rows, and the handle."""
    handle, out = Handle(), []
    answers = inbox_clock.Answers()
    answers.init(handle)
    for rows, mark in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * MS)
        frame = pd.DataFrame(rows, columns=["company_id", "id", "at", "kind", "deadline", "answer"]).assign(block=0)
        frame[["at", "deadline"]] = frame[["at", "deadline"]].apply(lambda c: pd.to_datetime(c * MS, unit="ms"))
        if len(frame):
            out += list(answers.handleInputRows((1, 0), iter([frame[::2], frame[1::2]]), clock))
        for t in sorted(t for t in handle.timers if t < mark * MS):
            handle.timers.discard(t)
            out += list(answers.handleExpiredTimer((1, 0), clock, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
    return sorted((r.id, r.outcome, r.at.value // 1_000_000 // MS) for df in out for r in df.itertuples()), handle


def test_a_block_is_read_and_written_once():
    records = [(1, i, 1, "record", 20, None) for i in range(4096)]
    got, handle = run([(records, 2)])
    assert got == [] and handle.calls < 10
    got, handle = run([(records, 2), ([], 30)])
    assert got == [(i, "deemed_accepted", 20) for i in range(4096)] and handle.calls < 20


def test_random_events_equal_a_loop():
    rng = random.Random(7)
    for _ in range(40):
        events, want = [], []
        for i in range(12):
            came, days = rng.randrange(1, 40), rng.randrange(5, 20)
            record = [(1, i, came, "record", came + days, None)] * rng.randrange(3)  # none: its record never comes
            actions = [(1, i, came + rng.randrange(-1, 30), "action", None, rng.choice(["accepted", "pending", "rejected"])) for _ in range(rng.randrange(3))]
            events += record + actions + actions[:1]
            first = min(((a[2], a[5]) for a in actions), default=None)
            if record:
                want.append((i, first[1], first[0]) if first and first[0] <= came + days else (i, "deemed_accepted", came + days))
        marks = [*range(0, 100, 9), 600, 1200]
        batches = [([e for e in events if low <= e[2] < high], high) for low, high in zip([-9, *marks], marks, strict=False)]
        got, handle = run(batches)
        unsaid = {e[1] for e in events} - {w[0] for w in want}
        assert got == sorted(want) and set(handle.value[0] if handle.value else []) == unsaid and not handle.timers
