"""Ranks, totals and last known values over ranges, against plain ones; a key with a third of the rows lies in several ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brasslark.operators import scans


def order():
    return [F.col("at").asc_nulls_first(), F.col("id")]


def rows(n: int = 3000):
    rng = random.Random(5)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        out.append((i, key, rng.choice([None, *range(n)]), rng.choice([None, None, float(rng.randint(0, 40))])))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, "id long, key string, at long, value double").repartition(5)


def in_order(data):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0]))


def test_places_and_totals(spark):
    want, seen, total = {}, {}, {}
    for i, key, _, value in in_order(rows()):
        want[i] = (seen.get(key, 0) + 1, total.get(key, 0))
        seen[key] = seen.get(key, 0) + 1
        total[key] = total.get(key, 0) + int(value or 0)
    assert {r["id"]: r["place"] for r in scans.placed(frame(spark), ["key"], order()).collect()} == {i: p for i, (p, _) in want.items()}
    assert {r["id"]: r["t"] for r in scans.before(frame(spark), ["key"], order(), t="value").collect()} == {i: t for i, (_, t) in want.items()}


def test_ranks(spark):
    data = rows()
    for descending in (True, False):
        out = {r["id"]: (r["rank"], r["n"]) for r in scans.ranked(frame(spark), ["key"], "value", descending).collect()}
        for i, key, _, value in data:
            pool = [r[3] for r in data if r[1] == key and r[3] is not None]
            assert out.get(i) == (None if value is None else (1 + sum(v > value if descending else v < value for v in pool), len(pool)))


def test_last_known(spark):
    want, known = {}, {}
    for i, key, _, value in in_order(rows()):
        if value is not None:
            known[key] = value
        want[i] = known.get(key)
    assert {r["id"]: r["value"] for r in scans.last_known(frame(spark), ["key"], order(), "value").collect()} == want


def test_nothing(spark):
    none = frame(spark, [])
    assert scans.placed(none, ["key"], order()).count() == scans.ranked(none, ["key"], "value").count() == scans.last_known(none, ["key"], order(), "value").count() == 0


def test_a_hot_key_is_spread(spark):
    df = frame(spark, [(i, "hot", i, None) for i in range(20000)])
    sizes = [r["count"] for r in scans._ranges(df, ["key"], order()).groupBy(scans._PART).count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
