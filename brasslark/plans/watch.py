"""Changes between two snapshots of a company, and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.numbers import divide
from brasslark.operators.joins import diff

#: Least changes that count, as a share of the old figure and in fractions of ownership.
RESTATED, MOVED, LARGE = 0.001, 0.005, 0.05
WATCHED = ("revenue", "net_income", "gross_profit", "total_assets", "stockholders_equity")


def fingerprint(years: DataFrame, stakes: DataFrame, n_years: int = 6, n_holders: int = 20) -> DataFrame:
    """ticker, latest_year, figures (year to metric to value), holders: what is remembered of a company."""
    w = Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))
    rows = years.where(F.col("fiscal_year").between(1990, 2100)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_years)
    figures = F.map_from_entries(F.sort_array(F.collect_list(F.struct("fiscal_year", F.struct(*WATCHED).alias("figures")))))
    a = rows.groupBy("ticker").agg(F.max("fiscal_year").alias("latest_year"), figures.alias("figures"))
    v = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("percent"), "owner")
    held = stakes.withColumn("_r", F.row_number().over(v)).where(F.col("_r") <= n_holders)
    b = held.groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("owner", "percent")))).alias("holders"))
    return a.join(b, "ticker", "full_outer")


def metric_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ticker, fiscal_year, metric, kind (new_year, new_metric, restated, gone), severity, old, new over tall snapshots (ticker, fiscal_year, metric, value). A company without an old snapshot is a baseline and raises none."""
    d = diff(old, new, ["ticker", "fiscal_year", "metric"], "value")
    known = old.select("ticker").distinct()
    had_year = old.select("ticker", "fiscal_year", F.lit(True).alias("had")).distinct()
    d = d.join(known, "ticker", "left_semi").join(had_year, ["ticker", "fiscal_year"], "left")
    moved = divide(F.abs(F.col("new") - F.col("old")), F.abs("old")) > RESTATED
    kind = F.when(~F.col("in_old") & F.col("had").isNull(), "new_year").when(~F.col("in_old"), "new_metric").when(~F.col("in_new"), "gone").when(moved, "restated")
    severity = F.when(kind.isin("new_year", "restated"), "high").otherwise("medium")
    return d.withColumn("kind", kind).where("kind is not null").select("ticker", "fiscal_year", "metric", "kind", severity.alias("severity"), "old", "new")


def holder_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ticker, owner, kind (new_holder, gone_holder, changed), severity, old, new over snapshots (ticker, owner, percent)."""
    d = diff(old, new, ["ticker", "owner"], "percent").join(old.select("ticker").distinct(), "ticker", "left_semi")
    delta = F.abs(F.col("new") - F.col("old"))
    kind = F.when(~F.col("in_old"), "new_holder").when(~F.col("in_new"), "gone_holder").when(delta >= MOVED, "changed")
    severity = F.when((~F.col("in_old") & (F.col("new") >= LARGE)) | (F.col("in_old") & F.col("in_new") & (delta >= LARGE)), "high").otherwise("medium")
    return d.withColumn("kind", kind).where("kind is not null").select("ticker", "owner", "kind", severity.alias("severity"), "old", "new")


def text_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ticker, kind (more_text, less_text), severity over snapshots (ticker, chunks)."""
    d = diff(old, new, ["ticker"], "chunks").where("in_old")
    delta = F.coalesce("new", F.lit(0)) - F.col("old")
    return d.withColumn("kind", F.when(delta > 0, "more_text").when(delta < 0, "less_text")).where("kind is not null").select("ticker", "kind", F.when(delta < 0, "high").otherwise("medium").alias("severity"), "old", "new")


def statuses(watched: DataFrame, old: DataFrame, changes: DataFrame) -> DataFrame:
    """ticker, status, changes: baseline (no snapshot before), changed, or ok; those not watched are not listed."""
    had = old.select("ticker", F.lit(True).alias("had")).distinct()
    n = changes.groupBy("ticker").agg(F.count(F.lit(1)).alias("changes"))
    j = watched.select("ticker").distinct().join(had, "ticker", "left").join(n, "ticker", "left").na.fill(0, ["changes"])
    return j.select("ticker", F.when(F.col("had").isNull(), "baseline").when(F.col("changes") > 0, "changed").otherwise("ok").alias("status"), "changes")


def recent_alerts(alerts: DataFrame, as_of: Column, days: int, limit: int) -> DataFrame:
    """The newest alerts of each key within the last days (columns key, at, id)."""
    w = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id"))
    rows = alerts.where((F.col("at") <= as_of) & (F.col("at") > as_of - F.make_dt_interval(F.lit(days))))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: a counter a table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        out = row if out is None else out.unionByName(row)
    return out


def anomalies(years: DataFrame, companies: DataFrame) -> DataFrame:
    """name, n: implausible years, figures without currency, figures without a company, companies without figures."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return (
        one("implausible_year", years.where(~F.col("fiscal_year").between(1990, 2100)))
        .unionByName(one("no_currency", years.where("currency is null")))
        .unionByName(one("orphan_figures", years.join(companies, "ticker", "left_anti")))
        .unionByName(one("no_figures", companies.join(years, "ticker", "left_anti")))
    )


def due(steps: DataFrame, as_of: Column) -> DataFrame:
    """steps (step, cadence_days, last_run) with `due`: never run, or the cadence has passed."""
    return steps.withColumn("due", F.col("last_run").isNull() | (F.datediff(as_of, "last_run") >= F.col("cadence_days")))
