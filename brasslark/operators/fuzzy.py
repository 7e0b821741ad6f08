"""Strings alike by the Ratcliff/Obershelp ratio, 2 M / (n + m) with M matched signs, as a similarity join that loses nothing.

Every pair of a ratio of r or more shares a number of tokens that follows from r: at least r (n + m) / 2 signs (a sign and the how
many-th of its kind is a token), and at least (3 r / 2 - 1) (n + m) - 1 pairs of neighbours, since at most (1 - r) (n + m) signs stay
unmatched and each breaks one run at most. If two sets share t tokens, the first |x| - t + 1 of both in any common order have
one in common; the order is from rare to frequent. Pairs that meet so are held against lengths, common signs and the Levenshtein
distance (no more than the unmatched signs) on the JVM; the ratio itself is computed once for each pair of strings left.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from math import ceil, comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.similarity import seq_ratio
from brasslark.sources.scratch import saved

#: Share of (n + m) from which pairs of neighbours tell more than signs, and the shortest string with enough of them.
NEIGHBOURS, LONG_ENOUGH = 0.2, 5
#: Variants of a string up to which strings meet by them.
VARIANTS = 200


def tokens(c: Column, n: int) -> Column:
    """The runs of n signs of a text, each with the number of its occurrence, so that repeated ones count."""
    whole = F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.transform(whole, lambda g, i: F.concat(g, F.size(F.filter(F.slice(whole, 1, i + 1), lambda x: x == g)).cast("string")))


def _fewest(n: Column, least: float) -> Column:
    """Length of the shortest string that a string of n signs can be that much alike."""
    return F.ceil(n * (least / (2 - least)) - 1e-9)


def _shared(total: Column, least: float, grams: int) -> Column:
    """Tokens that two strings of so many signs together share at least."""
    need = total * (least / 2) if grams == 1 else total * (1.5 * least - 1) - 1
    return F.greatest(F.ceil(need - 1e-9), F.lit(1))


def _prefixes(strings: DataFrame, column: str, frequency: DataFrame, least: float, grams: int) -> DataFrame:
    """(column, length, token) for the rarest tokens of each string, as many as must have one in common."""
    n = F.length(column)
    each = strings.select(column, n.alias("length"), F.explode(tokens(F.col(column), grams)).alias("token"))
    size = F.col("length") - (grams - 1)
    first = size - _shared(F.col("length") + _fewest(F.col("length"), least), least, grams) + 1
    each = each.join(frequency, "token", "left").withColumn("place", F.row_number().over(Window.partitionBy(column).orderBy(F.coalesce("k", F.lit(0)), "token")))
    return each.where(F.col("place") <= first).select(column, "length", "token")


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, ratio) of the different strings x of left and y of right (one column each) with a ratio of least or more.

    Neighbours are used if least allows it; then strings under LONG_ENOUGH signs meet by their signs. Null and empty strings
    are like none.
    """
    x = left.toDF("x").where("x <> ''").distinct()
    y = right.toDF("y").where("y <> ''").distinct()
    near, far = _by_lengths(x, y, least)
    found = [_near(x, y, least, near)] if near else []
    if far or not near:
        found += _far(*(s.where(F.length(c).isin({p[i] for p in far})) for i, (s, c) in enumerate(((x, "x"), (y, "y")))), least, near)
    return reduce(DataFrame.union, found)


def _by_lengths(x: DataFrame, y: DataFrame, least: float) -> tuple[dict[tuple[int, int], int], set[tuple[int, int]]]:
    """The pairs of lengths at which strings can be so much alike: those whose strings have few variants, with the signs of these, and the others. Lengths are few."""
    lengths = [[r["n"] for r in s.select(F.length(c).alias("n")).distinct().collect()] for s, c in ((x, "x"), (y, "y"))]
    near, far = {}, set()
    for n in lengths[0]:
        for m in lengths[1]:
            if 2.0 * min(n, m) >= least * (n + m) - 1e-9:
                signs = max(1, ceil((n + m) * (least / 2) - 1e-9))
                if max(comb(n, signs), comb(m, signs)) <= VARIANTS:
                    near[n, m] = signs
                else:
                    far.add((n, m))
    return near, far


def without(c: Column, n: int) -> Column:
    """The different strings that are left of a text without n of its signs."""
    left = F.array(c)
    for _ in range(n):
        each = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        left = F.array_distinct(F.flatten(F.transform(left, each)))
    return left


def _near(x: DataFrame, y: DataFrame, least: float, near: dict[tuple[int, int], int]) -> DataFrame:
    """The pairs whose lengths are in near; they meet by the hashes of their variants."""

    def variants(strings: DataFrame, column: str, side: int) -> DataFrame:
        by = defaultdict(set)
        for lengths, signs in near.items():
            by[lengths[side] - signs].add(lengths[side])
        each = [strings.where(F.length(column).isin(lengths)).select(column, (F.length(column) - gone).alias("signs"), F.explode(without(F.col(column), gone)).alias("v")) for gone, lengths in sorted(by.items())]
        return reduce(DataFrame.union, each).select(column, "signs", F.xxhash64("v").alias("v"))

    met = variants(_dealt(x, F.xxhash64("x")), "x", 0).join(variants(_dealt(y, F.xxhash64("y")), "y", 1), ["v", "signs"])
    met = met.where(F.col("signs") == _shared(F.length("x") + F.length("y"), least, 1)).select("x", "y")
    return _rated(_dealt(met, "x", "y").distinct(), least)


def _dealt(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has; rows of few bytes that take much time would be joined to one task else. Columns by which rows lie already deal nothing, but their hash does."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _rated(pairs: DataFrame, least: float) -> DataFrame:
    # written once, so that the ratio is not computed again by what reads it
    close = saved(pairs.select("x", "y").withColumn("ratio", F.when(F.col("x") == F.col("y"), 1.0).otherwise(seq_ratio("x", "y"))), "ratios")
    return close.where(F.col("ratio") >= least)


def _far(x: DataFrame, y: DataFrame, least: float, near: dict[tuple[int, int], int]) -> list[DataFrame]:
    """The pairs whose lengths are not in near."""
    if 1.5 * least - 1 < NEIGHBOURS:
        return [_met(x, y, least, 1, near)]
    return [_met(x.where(F.length("x") >= LONG_ENOUGH), y, least, 2, near), _met(x.where(F.length("x") < LONG_ENOUGH), y, least, 1, near)]


def _met(x: DataFrame, y: DataFrame, least: float, grams: int, near: dict[tuple[int, int], int]) -> DataFrame:
    frequency = y.select(F.explode(tokens(F.col("y"), grams)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    frequency = saved(frequency, "tokens")
    a, b = (_prefixes(s, c, frequency, least, grams) for s, c in ((x, "x"), (y, "y")))
    both = F.col("n") + F.col("m")
    fit = 2.0 * F.least("n", "m") >= least * both - 1e-9
    if near:
        fit &= ~(F.col("n").cast("long") * (1 << 32) + F.col("m")).isin([n * (1 << 32) + m for n, m in near])
    near = F.expr(f"levenshtein(x, y, cast(floor((n + m) * {1 - least!r} + 1e-9) as int))") >= 0  # where they meet, so that others are not shuffled
    pairs = a.withColumnRenamed("length", "n").join(b.withColumnRenamed("length", "m"), "token").where(fit).where(near).select("x", "y").distinct()
    pairs = pairs.select("x", "y", F.length("x").alias("n"), F.length("y").alias("m"))
    signs = lambda s, c: s.select(c, tokens(F.col(c), 1).alias(f"_{c}"))  # noqa: E731  once a string, not once a pair
    pairs = pairs.join(signs(x, "x"), "x").join(signs(y, "y"), "y").where(2.0 * F.size(F.array_intersect("_x", "_y")) >= least * both - 1e-9)
    return _rated(_dealt(pairs, "x", "y"), least)
