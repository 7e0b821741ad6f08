"""Joins that Spark's own join types do not name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.operators.scans import last_known


def asof(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str) -> DataFrame:
    """Adds to each left row the right side's latest value at or before `at`, as value and value_date.

    Both sides are merged into one timeline a key and the last known value is carried on, over ranges: no pairs, and a key may have any number of rows.
    """
    line = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(at)).unionByName(
        right.select(F.col(key), F.col(when).alias("_t"), F.struct(F.col(when).alias("d"), F.col(value).alias("v")).alias("_seen"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    last = last_known(line, [key], [F.col("_t"), F.col("_side")], "_seen").where("_side = 1")
    return last.select(*left.columns, F.col("_seen.v").alias(value), F.col("_seen.d").alias("value_date"))


def in_ranges(df: DataFrame, column: str, ranges: DataFrame, step: int = 100) -> DataFrame:
    """Inner join with ranges (lo, hi, ...) on lo <= column <= hi through buckets of `step`, so it is an equi join."""
    cut = lambda c: F.floor(c / step)
    parts = ranges.withColumn("_b", F.explode(F.sequence(cut(F.col("lo")), cut(F.col("hi")))))
    joined = df.withColumn("_b", cut(F.col(column))).join(parts, "_b").where(F.col(column).between(F.col("lo"), F.col("hi")))
    return joined.drop("_b", "lo", "hi")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, old, new: full outer join of two snapshots; a missing side is NULL. `in_old` and `in_new` say which sides have the key."""
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    return a.join(b, keys, "full_outer").withColumn("in_old", F.coalesce("in_old", F.lit(False))).withColumn("in_new", F.coalesce("in_new", F.lit(False)))


def stacked(first: DataFrame, second: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """Hits of two collections: the second only fills up what the first leaves of `limit` rows a key."""
    both = first.withColumn("priority", F.lit(0)).unionByName(second.withColumn("priority", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("priority", *order)
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
