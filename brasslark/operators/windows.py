"""Windows over companies and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.numbers import cagr_pct, change_pct
from brasslark.operators.scans import ranked


def growth(years: DataFrame, metric: str, key: str = "ticker") -> DataFrame:
    """Adds prev and growth_pct against exactly the year before; NULL where that year is missing."""
    w = Window.partitionBy(key).orderBy("fiscal_year")
    prev = F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.lag(metric).over(w))
    return years.withColumn("prev", prev).withColumn("growth_pct", change_pct(F.col(metric), F.col("prev")))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def span(years: DataFrame, metric: str, n: int, key: str = "ticker") -> DataFrame:
    """key, first_year, last_year, first_value, last_value, cagr_pct, change_pct over the last n years that have the metric."""
    rows = latest(years.where(F.col(metric).isNotNull()), [key], [F.desc("fiscal_year")], n)
    ends = rows.groupBy(key).agg(
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.min_by(metric, "fiscal_year").alias("first_value"), F.max_by(metric, "fiscal_year").alias("last_value")
    )
    gap = (F.col("last_year") - F.col("first_year")).cast("double")
    return ends.withColumn("cagr_pct", cagr_pct(F.col("first_value"), F.col("last_value"), gap)).withColumn("change_pct", change_pct(F.col("last_value"), F.col("first_value")))


def rank_in(df: DataFrame, pool: list[str], value: str) -> DataFrame:
    """Adds rank (1 is the largest, equals share the first), n of the pool that has the value, and percentile (100 is the top; NULL for a pool of one).

    A pool may be of any size: values are ranked over ranges.
    """
    out = ranked(df, pool, value)
    return out.withColumn("percentile", F.try_divide((F.col("n") - F.col("rank")) * 100.0, (F.col("n") - 1).cast("double"))).withColumn("rank", F.col("rank").cast("int"))


def with_share_below(df: DataFrame, pool: list[str], value: str, name: str, least: int = 5) -> DataFrame:
    """Adds the share of the pool strictly below, in percent; itself counts in the pool; NULL without a value and for pools under `least`. Pools may be of any size."""
    known = ranked(df, pool, value, descending=False).withColumn(name, F.when(F.col("n") >= least, (F.col("rank") - 1) * 100.0 / F.col("n"))).drop("rank", "n")
    return known.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def upper_median(value: str) -> Column:
    """The element at n // 2 of the sorted values: the upper of the two middle ones where n is even. Counts of values meet, not the values."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)")
