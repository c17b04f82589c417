"""Keyed state of feeds: newest items, marks that lapse by timers or by a time to live, across restarts."""

import datetime as dt
import json
import time

import pytest

from weftlake.streaming import marks

START = dt.datetime(2024, 1, 1)


def lines(rows):
    return "\n".join(json.dumps({"feed_url": f, "guid": g, "kind": k, "at": (START + dt.timedelta(hours=h)).isoformat() if h is not None else None}) for f, g, k, h in rows)


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def go(number, rows, **options):
        (tmp_path / "in" / f"{number}.json").write_text(lines(rows))
        marks.log_changes(spark.readStream.schema(marks.LOG).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), **options).awaitTermination()
        return sorted((r.feed_url, r.guid, r.change, (r.at - START).total_seconds() / 3600) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return go


def test_event_time(run):
    first = run(1, [("f", "a", "item", 1), ("f", "b", "item", 2), ("f", "a", "item", 3), ("f", "m", "read", 1), ("f", "k", "read", 2), ("h", "a", "item", 1), (None, "x", "item", 1), ("f", None, "read", 1), ("f", "x", "other", 1), ("f", "x", "item", None)], n=2, days=1)
    assert first == [("f", "a", "added", 1), ("f", "b", "added", 2), ("f", "k", "marked", 2), ("f", "m", "marked", 1), ("h", "a", "added", 1)]
    # c pushes a out; a is forgotten and comes again, and pushes b out; m is renewed, k is not
    second = run(2, [("f", "c", "item", 10), ("f", "a", "item", 11), ("f", "m", "read", 20), ("f", "c", "item", 30)], n=2, days=1)
    assert set(second) - set(first) == {("f", "c", "added", 10), ("f", "a", "evicted", 10), ("f", "a", "added", 11), ("f", "b", "evicted", 11), ("f", "k", "expired", 26)}
    # an unmarked guid has no later expiry; rows behind the watermark (30) are dropped; a mark made after the old one's life counts anew
    third = run(3, [("f", "z", "item", 5), ("f", "m", "unread", 31), ("f", "k", "read", 40), ("h", "k", "read", 40), ("h", "k", "read", 70), ("h", "q", "item", 90)], n=2, days=1)
    assert set(third) - set(second) == {("f", "m", "unmarked", 31), ("f", "k", "marked", 40), ("f", "k", "expired", 64), ("h", "k", "marked", 40), ("h", "k", "expired", 64), ("h", "k", "marked", 70), ("h", "q", "added", 90)}
    assert len(third) == len(set(third))


def test_time_to_live(run):
    options = {"n": 0, "days": 3 / 86400, "event_time": False}  # three seconds
    assert [r[2] for r in run(1, [("f", "m", "read", 1), ("f", "a", "item", 1)], **options)] == ["added", "marked"]
    time.sleep(4)
    again = run(2, [("f", "m", "read", 2), ("f", "a", "item", 2)], **options)
    assert [r[1:] for r in again] == [("a", "added", 1.0), ("m", "marked", 1.0), ("m", "marked", 2.0)]  # the mark was gone, the item was not


class Held:
    """A processor's handle over dicts: counts exchanges with the store and keeps the timers."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, [], {}

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.values.get(self.name)

    def update(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    def clear(self):
        self.handle.calls += 1
        del self.handle.values[self.name]


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs  # noqa: N815


def test_exchanges_with_the_store():
    """A feed's turn asks the store for as much as one mark does, however many rows it has, and one timer stands for all marks."""
    held, state = Held(), marks.FeedState(3, 1, True)
    state.init(held)
    rows = [{"micros": k * 1000, "kind": kind, "guid": f"{kind}{k}"} for k in range(40) for kind in ("item", "read")]
    out = [r.change for r in state.handleInputRows(("f",), rows, None)]
    assert (out.count("added"), out.count("evicted"), out.count("marked")) == (40, 37, 40)
    assert held.calls == 5 and held.timers == [86_400_000]
    list(state.handleInputRows(("f",), [{"micros": 50_000, "kind": "unread", "guid": "read0"}], None))
    assert held.timers == [86_400_001]
    gone = [r.guid for r in state.handleExpiredTimer(("f",), Now(86_400_003), Now(86_400_001))]
    assert sorted(gone) == ["read1", "read2", "read3"] and held.timers[-1] == 86_400_004
    assert sorted(r.guid for r in state.handleExpiredTimer(("f",), Now(99_000_000), Now(86_400_004)))[0] == "read10" and "marks" not in held.values
