"""Structured Streaming over event files: windows with watermarks, a stream-static join, a ledger, and restatements by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_parquet(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as a stream; broken lines are kept in _corrupt."""
    return spark.readStream.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark: the ledger of what was already taken."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_dimension(events: DataFrame, users: DataFrame) -> DataFrame:
    """A stream joined with a static table on user_id."""
    return events.join(users, "user_id", "left")


def restatements(values: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """key, kind (baseline, restated), old, new from a stream of (key, ts, value): the last value is kept as state, a change beyond tolerance is told."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).dropna(subset=["value"]).sort_values("ts", kind="stable")
        out = []
        for v in rows["value"].tolist():
            if last is None:
                out.append((key[0], "baseline", None, v))
            elif last and abs(v - last) / abs(last) > tolerance:
                out.append((key[0], "restated", last, v))
            last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "kind", "old", "new"])

    kind = dict(values.dtypes)["key"]
    return values.groupBy("key").applyInPandasWithState(step, f"key {kind}, kind string, old double, new double", "last double", "append", GroupStateTimeout.NoTimeout)


def newest_only(values: DataFrame) -> DataFrame:
    """key, newest: the largest fiscal year seen for each key, in update mode."""
    return values.groupBy("key").agg(F.max("fiscal_year").alias("newest"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there and stops; an outside scheduler starts it again."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
