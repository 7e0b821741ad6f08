"""Keyed state with timers: restatements of figures, a ledger that forgets, and refreshes that fall due.

Each is a StatefulProcessor for transformWithStateInPandas. State is in RocksDB (see `prepared`), one map entry a figure and not one
value a key; entries end by TTL or by a timer, so state does not grow with all that was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_RESTATED = "key string, item string, kind string, old double, new double, ts timestamp"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that state with timers and TTL needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Restatements(StatefulProcessor):
    """Per key a map from item to the last value and its time; rows older than an item's last time are told as late and change nothing."""

    def __init__(self, tolerance: float, ttl_ms: int | None):
        self.tolerance, self.ttl_ms = tolerance, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "item string", "value double, ts long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).dropna(subset=["value"]).sort_values(["ts", "item", "value"], kind="stable").itertuples(index=False):
            at = int(r.ts.value // 1000)
            known = self.last.getValue((r.item,)) if self.last.containsKey((r.item,)) else None
            old = None if known is None else float(known[0])
            if known is not None and at < known[1]:
                out.append((key[0], r.item, "late", old, r.value, r.ts))
                continue
            if known is None:
                out.append((key[0], r.item, "baseline", None, r.value, r.ts))
            elif old and abs(r.value - old) / abs(old) > self.tolerance:
                out.append((key[0], r.item, "restated", old, r.value, r.ts))
            self.last.updateValue((r.item,), (float(r.value), at))
        if out:
            yield pd.DataFrame(out, columns=["key", "item", "kind", "old", "new", "ts"])

    def close(self) -> None:
        pass


def restatements(values: DataFrame, tolerance: float = 0.001, ttl_ms: int | None = None) -> DataFrame:
    """key, item, kind (baseline, restated, late), old, new, ts from a stream of (key string, item string, ts timestamp, value double).

    An item without a new value for ttl_ms (processing time) is forgotten and gets a baseline again.
    """
    rows = values.select(F.col("key").cast("string").alias("key"), "item", "ts", "value")
    return rows.groupBy("key").transformWithStateInPandas(Restatements(tolerance, ttl_ms), outputStructType=_RESTATED, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class Ledger(StatefulProcessor):
    """The first row of each key; a key may come again once the watermark is `keep_ms` past its first row."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        if self.first.exists():
            return
        first = batch["ts"].iloc[0]
        at = int(first.value // 1_000_000)
        self.first.update((at,))
        self.handle.registerTimer(at + self.keep_ms)
        yield pd.DataFrame({"key": [key[0]], "ts": [first]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def ledger(events: DataFrame, keep_ms: int, late: str = "0 seconds") -> DataFrame:
    """key, ts: the first row of each key in a stream of (key, ts), and again after keep_ms of event time."""
    rows = events.select(F.col("key").cast("string").alias("key"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Ledger(keep_ms), outputStructType="key string, ts timestamp", outputMode="Append", timeMode="EventTime")


class Cadence(StatefulProcessor):
    """When each source was last read; a timer tells that it is due, `every_ms` after the newest read, unless a newer one came before."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = int(pd.concat(list(rows))["ts"].max().value // 1_000_000)
        if not self.newest.exists() or at > self.newest.get()[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.newest.update((at,))
            self.handle.registerTimer(at + self.every_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.Timestamp(self.newest.get()[0], unit="ms")
        yield pd.DataFrame({"key": [key[0]], "last_read": [last], "due_at": [last + pd.Timedelta(self.every_ms, unit="ms")]})

    def close(self) -> None:
        pass


def due(reads: DataFrame, every_ms: int, late: str = "0 seconds") -> DataFrame:
    """key, last_read, due_at: told once the watermark passes due_at, from a stream of (key, ts) of sources read."""
    rows = reads.select(F.col("key").cast("string").alias("key"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Cadence(every_ms), outputStructType="key string, last_read timestamp, due_at timestamp", outputMode="Append", timeMode="EventTime")
