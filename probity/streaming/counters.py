"""Streaming forms of the activity counters."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The provider that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_per_minute(stream: DataFrame, ts: str, user: str, late: str = "10 minutes") -> DataFrame:
    """Rows of each user by minute; rows later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "60 seconds"), user).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), user, "n")


def bursts(stream: DataFrame, ts: str, user: str, late: str = "1 hour") -> DataFrame:
    """Rows of each user by hour."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), user).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), user, "n")


def first_of_key(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Trailing(StatefulProcessor):
    """Events of one key by second; the count of a second is told when the watermark has passed it."""

    def __init__(self, user: str, ts: str, span: int):
        self.user, self.ts, self.span = user, ts, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "second long", "n long")
        self.told = handle.getValueState("told", "second long")

    def _told(self) -> int:
        return self.told.get()[0] if self.told.exists() else -(1 << 62)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, new = self._told(), Counter()
        for part in rows:
            seconds = part[self.ts].astype("int64") // 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}[getattr(part[self.ts].dt, "unit", "ns")]
            new.update({int(s): int(n) for s, n in seconds.value_counts().items() if s > told})
        for second, n in new.items():
            was = self.events.getValue((second,))[0] if self.events.containsKey((second,)) else 0
            self.events.updateValue((second,), (was + n,))
        if new:
            self.handle.registerTimer(min(new) * 1000 + 999)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told, upto = self._told(), (timerValues.getCurrentWatermarkInMs() - 999) // 1000
        held = sorted((s[0], n[0]) for s, n in self.events.iterator())
        seconds, counts = (np.array(x, dtype=np.int64) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        sums = np.concatenate([[0], np.cumsum(counts)])
        due = (seconds > told) & (seconds <= upto)
        first = np.searchsorted(seconds, seconds - self.span)
        n = sums[1:] - sums[first]
        for s in seconds[seconds < upto - self.span]:
            self.events.removeKey((int(s),))
        self.told.update((max(told, upto),))
        later = seconds[seconds > upto]
        if len(later):
            self.handle.registerTimer(int(later[0]) * 1000 + 999)
        if due.any():
            yield pd.DataFrame({self.user: [key[0]] * int(due.sum()), "second": seconds[due], "events": counts[due], "n": n[due]})

    def close(self) -> None:
        pass


def trailing_count(stream: DataFrame, ts: str, user: str, span: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user, second, events, n) of every second with events of a user: those events, and the events of the `span`
    seconds up to it, both ends included. Rows may come in any order within `late`; later ones are left out.

    A second is told once, when no more row of it can come, so n is what a range window over the whole table gives.
    A user's state is a number for each second of the last `span` and `late`, however many events they hold.
    The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    kind = stream.schema[user].dataType.simpleString()
    rows = stream.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).select(user, ts)
    return rows.groupBy(user).transformWithStateInPandas(_Trailing(user, ts, span), f"{user} {kind}, second long, events long, n long", "Append", "EventTime")
