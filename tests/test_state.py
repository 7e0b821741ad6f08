"""Streams with state and timers, file by file, against what a plain walk over the rows gives."""

from __future__ import annotations

import os
import shutil
from datetime import datetime, timedelta

import pytest

from brasslark.streaming import state

START = datetime(2024, 1, 1)
HOUR = 3_600_000


def at(hours: float) -> datetime:
    return START + timedelta(hours=hours)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a streaming function over files that come one a batch, in this order."""
    state.prepared(spark)

    def run(files, schema, f, **trigger):
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f{i}")
        names = [f"{tmp_path}/f{i}" for i in range(len(files))]
        got = []
        for name in names:  # a start a file; the checkpoint carries the state on
            os.makedirs(f"{tmp_path}/in", exist_ok=True)
            for part in os.listdir(name):
                if part.endswith(".parquet"):
                    shutil.copy(f"{name}/{part}", f"{tmp_path}/in/{os.path.basename(name)}-{part}")
            rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            q = f(rows).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(**(trigger or {"availableNow": True})).start()
            q.awaitTermination(60)
            q.stop()
        return got

    return run


def test_restatements_keep_a_map_of_items(stream):
    schema = "key string, item string, ts timestamp, value double"
    files = [
        [("a", "revenue/2023", at(1), 100.0), ("a", "income/2023", at(1), 5.0), ("b", "revenue/2023", at(2), None), ("a", "revenue/2023", at(2), 100.05)],
        [("a", "revenue/2023", at(4), 90.0), ("b", "revenue/2023", at(3), 7.0), ("a", "income/2023", at(0.5), 6.0)],
        [("a", "income/2023", at(5), 5.0), ("a", "revenue/2023", at(3), 80.0)],
    ]
    got = stream(files, schema, state.restatements)
    want, last = [], {}
    for rows in files:
        for k, item, ts, v in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1])):
            old = last.get((k, item))
            kind = "baseline" if old is None else "late" if ts < old[1] else "restated" if abs(v - old[0]) / old[0] > 0.001 else None
            want += [(k, item, kind, old and old[0], v, ts)] if kind else []
            if kind != "late":
                last[k, item] = (v, ts)
    assert sorted(got, key=str) == sorted(want, key=str) and {r[2] for r in got} == {"baseline", "late", "restated"}


def test_items_are_forgotten_after_their_time(stream):
    schema = "key string, item string, ts timestamp, value double"
    got = stream([[("a", "x", at(1), 1.0)], [("a", "x", at(2), 9.0)]], schema, lambda df: state.restatements(df, ttl_ms=1), once=True)
    assert [r[2] for r in got] == ["baseline", "baseline"]


def test_the_ledger_forgets(stream):
    files = [[("a", at(0)), ("a", at(0.1)), ("b", at(0.2))], [("a", at(1)), ("c", at(3))], [("z", at(8))], [("a", at(9)), ("c", at(9))]]
    got = stream(files, "key string, ts timestamp", lambda df: state.ledger(df, 4 * HOUR))
    assert sorted(r for r in got if r[0] != "z") == sorted([("a", at(0)), ("b", at(0.2)), ("c", at(3)), ("a", at(9)), ("c", at(9))])


def test_timers_tell_what_is_due(stream):
    """Against the batch rule: after each file, a source is due if its newest read is `every` or more before the newest row; it is told once a read."""
    files = [[("a", at(0)), ("b", at(1))], [("a", at(5))], [("c", at(12))], [("z", at(19))], [("c", at(20)), ("z", at(21))], [("c", at(22))]]
    got = stream(files, "key string, ts timestamp", lambda df: state.due(df, 6 * HOUR))
    want, newest = set(), {}
    for rows in files:
        for k, ts in rows:
            newest[k] = max(ts, newest.get(k, ts))
        now = max(newest.values())
        want |= {(k, ts, ts + timedelta(hours=6)) for k, ts in newest.items() if ts + timedelta(hours=6) <= now}
    assert sorted(got) == sorted(want) and len(want) == 3
