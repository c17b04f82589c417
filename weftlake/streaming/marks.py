"""Items and read marks of feeds as keyed state: the newest items stay, marks lapse by timers or by a time to live."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftlake.operators.feeds import KEPT_ITEMS, MARK_DAYS

LOG = "feed_url string, guid string, kind string, at timestamp"
CHANGE = "feed_url string, guid string, change string, micros long"
_CHANGE = Row("feed_url", "guid", "change", "micros")
#: Of a day in microseconds.
DAY = 86_400_000_000


class _Apart:
    """A map of the state with an entry of its own for each guid: a change of few of many writes those only."""

    def __init__(self, state):
        self.state = state

    def held(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.state.iterator()}

    def put(self, before: dict[str, int], after: dict[str, int]) -> None:
        for guid in before.keys() - after.keys():
            self.state.removeKey((guid,))
        for guid, at in after.items():
            if before.get(guid) != at:
                self.state.updateValue((guid,), (at,))


class _Whole:
    """A map of the state in one value: one exchange with the store reads it and one writes it, however many guids it has."""

    TYPE = "guids array<string>, ats array<long>"

    def __init__(self, state):
        self.state = state

    def held(self) -> dict[str, int]:
        value = self.state.get()
        return dict(zip(value[0], value[1], strict=True)) if value else {}

    def put(self, before: dict[str, int], after: dict[str, int]) -> None:
        if after and after != before:
            self.state.update((list(after), list(after.values())))
        elif before and not after:
            self.state.clear()


class FeedState(StatefulProcessor):
    """For each feed its newest items by guid and its read marks.

    An item that falls out of the newest n is forgotten, so it counts as added when it comes again. A mark lapses `days` after it was made; marking again before that renews it. In event time a feed
    has one timer, for the first end of a mark's life; when the watermark has passed it, all marks whose life is over go and the timer is set anew. In processing time the map's own time to live
    removes marks, and without a word. What is held is one value for each of items and marks; items without a bound, and marks with a time to live, are a map.
    """

    def __init__(self, n: int, days: float, event_time: bool):
        self.n, self.life, self.event_time = n, int(days * DAY), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = _Whole(handle.getValueState("items", _Whole.TYPE)) if self.n > 0 else _Apart(handle.getMapState("items", "guid string", "at long"))
        self.marks = _Whole(handle.getValueState("marks", _Whole.TYPE)) if self.event_time else _Apart(handle.getMapState("marks", "guid string", "at long", self.life // 1000))

    def _first_end(self, marks: dict[str, int]) -> int | None:
        """Milliseconds at which the first mark's life is over."""
        return -(-(min(marks.values()) + self.life) // 1000) if marks else None

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        items, marks = self.items.held(), self.marks.held()
        items_before, marks_before = dict(items), dict(marks)
        for at, kind, guid in sorted((r["micros"], r["kind"], r["guid"]) for r in rows):
            if kind == "item":
                if guid in items:
                    continue
                items[guid] = at
                yield self._row(key, guid, "added", at)
                if 0 < self.n < len(items):  # the oldest goes, of equal times the greatest guid
                    old = min(items.values())
                    gone = max(g for g, t in items.items() if t == old)
                    del items[gone]
                    yield self._row(key, gone, "evicted", at)
            elif kind == "read":
                if guid in marks and at >= marks[guid] + self.life:  # the timer has not come round yet
                    yield self._row(key, guid, "expired", marks.pop(guid) + self.life)
                if guid not in marks:
                    yield self._row(key, guid, "marked", at)
                marks[guid] = at
            elif kind == "unread" and marks.pop(guid, None) is not None:
                yield self._row(key, guid, "unmarked", at)
        self.items.put(items_before, items)
        self.marks.put(marks_before, marks)
        if self.event_time:
            self._reset(self._first_end(marks_before), self._first_end(marks))

    def _reset(self, was: int | None, now: int | None) -> None:
        """One timer, for the first end of life of the marks that are held."""
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        marks = self.marks.held()
        left = {g: at for g, at in marks.items() if at + self.life > now}
        for guid in marks.keys() - left.keys():
            yield self._row(key, guid, "expired", marks[guid] + self.life)
        self.marks.put(marks, left)
        if left:  # the timer that came round goes by itself
            self.handle.registerTimer(self._first_end(left))

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, guid: str, change: str, at: int) -> Row:
        return _CHANGE(key[0], guid, change, at)


def feed_changes(log: DataFrame, n: int = KEPT_ITEMS, days: float = MARK_DAYS, event_time: bool = True, delay: str = "0 seconds") -> DataFrame:
    """(feed_url, guid, change, at) of a stream of (feed_url, guid, kind, at), kind item, read or unread.

    change: added, evicted, marked, unmarked, expired; at is the time of the row that brought it, of an expired mark the end of its life. In event time rows older than the watermark, which lags by
    `delay`, are dropped; rows of a feed that come together are taken by time. The session's state store must be the RocksDB one (see rocks()). Rows without a feed, guid or time are left out.
    """
    rows = log.where("feed_url is not null and guid is not null and at is not null and kind in ('item', 'read', 'unread')")
    rows = (rows.withWatermark("at", delay) if event_time else rows).withColumn("micros", F.unix_micros("at"))
    rows = rows.select("feed_url", "guid", "kind", *(["at"] if event_time else []), "micros")
    out = rows.groupBy("feed_url").transformWithState(FeedState(n, days, event_time), CHANGE, "append", "EventTime" if event_time else "ProcessingTime")
    return out.select("feed_url", "guid", "change", F.timestamp_micros("micros").alias("at"))


def rocks(spark) -> None:
    """Sets the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log_changes(log: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, **options):
    """Runs all that waits of the log and stops; changes go to the Parquet table at `table`, each batch once. In processing time, where a query that waits for times to live never runs dry, it is one batch."""
    rocks(log.sparkSession)
    trigger = trigger or ({"availableNow": True} if options.get("event_time", True) else {"once": True})
    return feed_changes(log, **options).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**trigger).start()
