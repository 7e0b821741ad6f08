"""Running totals, ranks and last known values whose keys may be of any size: rows are dealt by ranges, and what crosses a range is carried."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.sources.scratch import saved

_PART = "_part"


def _bare(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df in the order of keys and order, cut into ranges, with the number of its range; rows equal in both stay together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *order).withColumn(_PART, F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, keys: list[str], totals: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """keys, range and what the ranges before it bring, for keys that lie in several ranges. At most two rows a range, so it may be broadcast."""
    each = rows.groupBy(*keys, _PART).agg(*[c.alias(n) for n, c in totals.items()])
    several = each.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_ranges > 1")
    return several.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(_PART).alias("_p"), *[c.alias(n) for n, c in over.items()])


def _brought(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col(_PART) == F.col("_p"))
    return rows.join(F.broadcast(carried), on, "left")


def before(df: DataFrame, keys: list[str], order: list[Column], **amounts: Column | str) -> DataFrame:
    """Adds, for each name, the sum of its amount (a long, null counts as 0) over the rows of the same key that come earlier.

    Rows equal in keys and order have no stated order among each other. Null keys are a key of their own.
    """
    return _before(_ranges(df, keys, order), keys, order, amounts).drop(_PART)


def _before(rows: DataFrame, keys: list[str], order: list[Column], amounts: dict[str, Column | str]) -> DataFrame:
    """before, of rows that are in ranges; they keep the number of their range."""
    amounts = {n: F.coalesce(_bare(c).cast("long"), F.lit(0).cast("long")) for n, c in amounts.items()}
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_all_{n}": F.sum(c) for n, c in amounts.items()}
    carried = _carried(rows, keys, sums, {f"_from_{n}": F.sum(f"_all_{n}").over(earlier) for n in amounts})
    own = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in amounts.items()})
    out = _brought(local, carried, keys)
    return out.select(*rows.columns, *[(F.col(f"_own_{n}") + F.coalesce(f"_from_{n}", F.lit(0))).alias(n) for n in amounts])


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place among the rows of its key, from 1."""
    return before(df, keys, order, **{name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def ranked(df: DataFrame, keys: list[str], value: str, descending: bool = True) -> DataFrame:
    """Adds rank (1 is the largest, or the smallest; equals share the first) and n, the rows of the key, over rows that have the value.

    Rows of one value are counted first, so what is put in order is the distinct values of a key, in ranges. One joined
    row a value comes back; where a value is hot, the join's rows can be dealt anew.
    """
    known = df.where(F.col(value).isNotNull())
    order = [F.desc(value) if descending else F.asc(value)]
    counts = _ranges(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, order)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    places = _before(counts, keys, order, {"rank": "_n"}).withColumn("rank", F.col("rank") + 1).drop("_n", _PART)

    def back(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        named = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(on)], *[c for c in right.columns if c not in on])
        return left.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(on)))).drop(*[f"_j{i}" for i in range(len(on))])

    return back(back(known, places, [*keys, value]), sizes, keys)


def last_known(df: DataFrame, keys: list[str], order: list[Column], *values: str) -> DataFrame:
    """Each of values, where null, becomes the last one known before it within the key."""
    rows = _ranges(df, keys, order)
    up_to = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"_own_{v}": F.last(v, ignorenulls=True).over(up_to) for v in values})
    # the last known of a range is the one at its greatest place
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(_PART, *keys).orderBy(*order)))
    ends = {f"_end_{v}": F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))) for v in values}
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(numbered, keys, ends, {f"_from_{v}": F.last(f"_end_{v}", ignorenulls=True).over(earlier) for v in values})
    out = _brought(local, carried, keys)
    return out.select(*[F.coalesce(f"_own_{c}", f"_from_{c}").alias(c) if c in values else F.col(c) for c in df.columns])
