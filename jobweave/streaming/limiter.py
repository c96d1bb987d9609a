"""A limiter of events by key: a window opens with a key's first event and accepts a number of events until it ends."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from jobweave.operators.events import first_event_windows

MOST, WINDOW = 60, 60.0
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs; a store that the session has chosen stays."""
    if "RocksDB" not in (spark.conf.get(_STORE, "") or ""):
        spark.conf.set(_STORE, _ROCKS)


class _Windows(StatefulProcessor):
    """A key's open window (when it opened, events so far) as a value, and a timer at its end."""

    def __init__(self, names: list[str], ts: str, order: str, most: int, window: float):
        self.names, self.ts, self.order, self.most, self.length = names, ts, order, most, round(window * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", T.StructType([T.StructField("opened", T.LongType()), T.StructField("count", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values([self.ts, self.order])
        opened, count = self.window.get() if self.window.exists() else (None, 0)
        began, accepted = opened, []
        for t in data[self.ts].astype("datetime64[us]").astype("int64").tolist():
            if opened is None or t >= opened + self.length:
                opened, count = t, 0
            count += 1
            accepted.append(count <= self.most)
        self.window.update((opened, count))
        if opened != began:
            self.handle.registerTimer(-(-(opened + self.length) // 1000))
        yield data[self.names].assign(accepted=accepted)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A timer of a window that another one has followed leaves that one alone.
        if self.window.exists() and self.window.get()[0] + self.length <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit(events: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", most: int = MOST, window: float = WINDOW, late: str | None = "1 minute") -> DataFrame:
    """A stream of events with accepted.  A key's state is dropped by a timer when its window has passed.

    Events of a batch are taken in order of time; an event that comes after later ones of its key counts in the window that is
    open then; one that comes later than ``late`` is dropped.  ``ts`` stays the stream's event time, so windowed counts can
    follow in the same query; with ``late`` None the stream brings its own watermark.  Events without a time or a key are dropped.
    """
    keyed_state(events.sparkSession)
    rows = (events.withWatermark(ts, late) if late else events).where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    names = [f.name for f in rows.schema.fields if f.name != "accepted"]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("accepted", T.BooleanType())])
    processor = _Windows(names, ts, order, most, window)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime", eventTimeColumnName=ts)


def replay(events: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", most: int = MOST, window: float = WINDOW) -> DataFrame:
    """The same verdicts over a table of events, without Python and without a task that holds all events of a key."""
    return first_event_windows(events, key, ts, order, most, window)
