"""Lookup, comparison, screening and coverage of company figures. No result mixes currencies in one ranking."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from brasslark.catalog import METRICS
from brasslark.operators.graph import INFRA, STRUCTURED, degrees
from brasslark.operators.vector import indexed

#: Comparison operators a screen may use.
OPERATORS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}


def plausible(year: Column) -> Column:
    """Years that can be fiscal years; serial dates are not."""
    return year.between(1990, 2100)


def lookup(years: DataFrame, tickers: DataFrame, metrics: Iterable[str] | None = None, wanted_years: Iterable[int] | None = None, limit: int = 12) -> DataFrame:
    """ticker, fiscal_year, currency, metric, value: the newest `limit` years of the companies asked for; unknown metrics are ignored, NULLs left out."""
    names = [m for m in (metrics or METRICS) if m in METRICS]
    rows = years.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    if wanted_years is not None:
        rows = rows.where(F.col("fiscal_year").isin(*wanted_years))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fiscal_year")))).where(F.col("_r") <= limit)
    return rows.unpivot(["ticker", "fiscal_year", "currency"], names, "metric", "value").where("value is not null")


def compare(years: DataFrame, tickers: DataFrame, metric: str, year: int | None = None) -> DataFrame:
    """fiscal_year, currency, ticker, value, place in its currency, mixed (whether the year has several currencies)."""
    rows = years.join(tickers.select("ticker").distinct(), "ticker", "left_semi").where(F.col(metric).isNotNull())
    if year is not None:
        rows = rows.where(F.col("fiscal_year") == year)
    rows = rows.withColumn("currency", F.coalesce("currency", F.lit("USD"))).select("fiscal_year", "currency", "ticker", F.col(metric).alias("value"))
    place = F.row_number().over(Window.partitionBy("fiscal_year", "currency").orderBy(F.desc("value"), "ticker"))
    w = Window.partitionBy("fiscal_year")
    return rows.withColumn("place", place).withColumn("mixed", F.min("currency").over(w) != F.max("currency").over(w))


def missing(years: DataFrame, tickers: DataFrame, metric: str, year: int) -> DataFrame:
    """Companies asked for that have no value of the metric in the year."""
    return tickers.select("ticker").distinct().join(years.where((F.col("fiscal_year") == year) & F.col(metric).isNotNull()), "ticker", "left_anti")


def valid_filters(filters: Iterable[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    return [(m, op, v) for m, op, v in filters if m in METRICS and op in OPERATORS]


def screen(years: DataFrame, filters: Iterable[tuple[str, str, float]], year: int, order_by: str, limit: int = 20, currency: str = "USD") -> DataFrame:
    """The top `limit` companies of a year and currency that pass all filters (metric, operator, value). Invalid filters are skipped; none left is an error."""
    good = valid_filters(filters)
    if not good or order_by not in METRICS:
        raise ValueError("invalid_filters")
    passes = reduce(and_, [OPERATORS[op](F.col(m), F.lit(float(v))) for m, op, v in good])
    rows = years.where((F.col("fiscal_year") == year) & (F.coalesce("currency", F.lit("USD")) == currency) & passes & F.col(order_by).isNotNull())
    names = list(dict.fromkeys([order_by, *(m for m, _, _ in good)]))
    return rows.select("ticker", "name", "fiscal_year", "currency", *names).orderBy(F.desc(order_by), "ticker").limit(limit)


def _reason(filters: Iterable[tuple[str, str, float]], currency: str) -> Column:
    """Why a row of the year is not in the screen, or kept."""
    good = valid_filters(filters)
    passes = reduce(and_, [OPERATORS[op](F.col(m), F.lit(float(v))) for m, op, v in good])
    known = reduce(and_, [F.col(m).isNotNull() for m, _, _ in good])
    return F.when(F.coalesce("currency", F.lit("USD")) != currency, "other_currency").when(~known, "unknown_value").when(~passes, "filtered").otherwise("kept")


REASONS = ("other_currency", "unknown_value", "filtered", "kept")


def screened_out(years: DataFrame, filters: Iterable[tuple[str, str, float]], year: int, currency: str = "USD") -> DataFrame:
    """reason, n: why companies of the year are not in the screen; every dropped row has one reason."""
    return years.where(F.col("fiscal_year") == year).groupBy(_reason(filters, currency).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def screen_observed(years: DataFrame, filters: Iterable[tuple[str, str, float]], year: int, order_by: str, limit: int = 20, currency: str = "USD") -> tuple[DataFrame, Observation]:
    """A screen, and the counts of screened_out taken on the same pass: `get` gives them once the screen has run."""
    filters = list(filters)
    reason, counts = _reason(filters, currency), Observation()
    rows = years.where(F.col("fiscal_year") == year).observe(counts, *[F.count_if(reason == r).alias(r) for r in REASONS])
    return screen(rows, filters, year, order_by, limit, currency), counts


def coverage(companies: DataFrame, years: DataFrame, edges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """ticker, years, first_year, last_year, knowledge, ownership, chunks: each side is summed up before it is joined."""
    per = years.where(plausible(F.col("fiscal_year"))).groupBy("ticker").agg(F.count(F.lit(1)).alias("years"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    deg = degrees(edges).select(F.col("node").alias("ticker"), "knowledge", "ownership")
    out = companies.select("ticker").join(per, "ticker", "left").join(deg, "ticker", "left")
    out = out.join(chunks, "ticker", "left") if chunks is not None else out.withColumn("chunks", F.lit(0).cast("long"))
    return out.na.fill(0, ["years", "knowledge", "ownership", "chunks"])


def top_revenue(years: DataFrame, since: int, n: int) -> DataFrame:
    """currency, ticker, revenue, place: the largest revenue of each company since a year, ranked in its currency."""
    top = years.where(F.col("fiscal_year") >= since).groupBy("currency", "ticker").agg(F.max("revenue").alias("revenue"))
    w = Window.partitionBy("currency").orderBy(F.desc("revenue"), "ticker")
    return top.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def gaps(cover: DataFrame) -> DataFrame:
    """ticker, gaps: what is missing for each company, as a list of names."""
    notes = F.array_compact(F.array(F.when(F.col("years") == 0, "no_figures"), F.when(F.col("knowledge") == 0, "no_relations"), F.when(F.col("ownership") == 0, "no_owners"), F.when(F.col("chunks") == 0, "no_text")))
    return cover.select("ticker", notes.alias("gaps"))


def _listed(rows: DataFrame, key: str, order: list[Column], n: int, name: str, *columns: str) -> DataFrame:
    """key and an array of the first n rows of each key, in order, as structs of columns after their place."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
    return first.groupBy(F.col(key).alias("ticker")).agg(F.sort_array(F.collect_list(F.struct(F.col("_r").alias("place"), *columns))).alias(name))


def brief(companies: DataFrame, years: DataFrame, edges: DataFrame, chunks: DataFrame, peers: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One row a company: coverage, figures of the last n years, holders and holdings, business relations, text, peers, gaps.

    Holders are who owns the company, holdings what it owns: the largest stakes first, those without a share last; relations leave
    stakes out. Text is the newest chunks (chunk_id, ticker, fiscal_year); peers (ticker, metric, rank, n) are taken as they are.
    A section that has nothing is NULL, and gaps names it.
    """
    stakes, business = edges.where(F.col("rel").isin(*STRUCTURED)), edges.where(~F.col("rel").isin(*STRUCTURED, *INFRA))
    share = F.desc_nulls_last("percent")
    sections = [
        _listed(years, "ticker", [F.desc("fiscal_year")], n, "figures", "fiscal_year", "revenue", "net_income", "stockholders_equity"),
        _listed(stakes, "src", [share, F.col("dst")], 8, "holders", "dst", "percent", "as_of"),
        _listed(stakes, "dst", [share, F.col("src")], 8, "holdings", "src", "percent", "as_of"),
        _listed(business, "src", [F.desc("mentions"), F.col("rel"), F.col("dst")], 8, "relations", "rel", "dst", "mentions", "evidence"),
        _listed(chunks, "ticker", [F.desc("fiscal_year"), F.col("chunk_id")], 4, "text", "chunk_id", "fiscal_year"),
        *([_listed(peers, "ticker", [F.col("metric")], 20, "peers", "metric", "rank", "n")] if peers is not None else []),
    ]
    cover = coverage(companies, years, edges, indexed(chunks).select("ticker", "chunks"))
    out = companies.select("ticker", "name").join(cover, "ticker").join(gaps(cover), "ticker")
    for section in sections:
        out = out.join(section, "ticker", "left")
    return out
