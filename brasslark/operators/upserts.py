"""Merges of new rows into stored tables. Each returns the table after the merge; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Data tiers, lowest first. A tier only rises.
TIERS = ("metrics", "text", "graph")


def tier_rank(c) -> F.Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), c), F.lit(1))


def tier_name(rank) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank.cast("int"))


def upsert_listed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by cik (ticker, cik, name, exchange, tier): a stored name and tier stay, the rest is taken from the new row."""
    j = old.alias("o").join(new.alias("n"), "cik", "full_outer")
    return j.select("cik", F.coalesce("n.ticker", "o.ticker").alias("ticker"), F.coalesce("o.name", "n.name").alias("name"), F.coalesce("n.exchange", "o.exchange").alias("exchange"), F.coalesce("o.tier", F.lit("metrics")).alias("tier"))


def upsert_named(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by ticker (ticker, name, short_name, sector, tier): the new name wins, other fields keep the old value where the new is NULL."""
    j = old.alias("o").join(new.alias("n"), "ticker", "full_outer")
    return j.select("ticker", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("name", "short_name", "sector")], F.coalesce("o.tier", F.lit("metrics")).alias("tier"))


def upsert_years(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Wide rows by key: every column of a new row that is not NULL replaces the old one."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in columns if c != key]).select(*columns)


def upsert_edges(old: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges (src, rel, dst, mentions, confidence, evidence): mentions add up, the last row (column load_order) gives the attributes. tasks: how many the edges are dealt to (Spark's choice if None)."""
    both = old.withColumn("load_order", F.lit(-1).cast("long")).unionByName(new.select(*old.columns, F.col("load_order").cast("long")))
    if tasks:
        both = both.repartition(tasks, "src", "rel", "dst")
    last = F.max_by(F.struct("confidence", "evidence"), F.col("load_order"))
    return both.groupBy("src", "rel", "dst").agg(F.sum("mentions").alias("mentions"), last.alias("_l")).select("src", "rel", "dst", "mentions", "_l.confidence", "_l.evidence")


def link_owners(holders: DataFrame, companies: DataFrame) -> DataFrame:
    """Shareholder rows (company, owner, percent, kind) with owner_key and owner_label: a company of that name, else a person of that company or a shared organisation. Self-ownership goes."""
    names = companies.select(F.lower(F.trim("name")).alias("_name"), F.col("ticker").alias("_ticker")).dropDuplicates(["_name"])
    j = holders.join(names, F.lower(F.trim("owner")) == F.col("_name"), "left")
    person = F.col("kind") == "person"
    label = F.when(F.col("_ticker").isNotNull(), "Company").when(person, "Person").otherwise("Organization")
    key = F.coalesce("_ticker", F.when(person, F.concat("owner", F.lit(" ("), "company", F.lit(")"))).otherwise(F.col("owner")))
    evidence = F.format_string("%s holds %.2f%% of %s", F.col("owner"), F.col("percent") * 100, F.col("company"))
    rows = j.select("company", key.alias("owner_key"), label.alias("owner_label"), "percent", evidence.alias("evidence")).where("company <> owner_key")
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("company", "owner_key").orderBy(F.desc_nulls_last("percent"), "evidence"))).where("_rn = 1").drop("_rn")


def raise_tiers(companies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Companies (ticker, tier) with the higher of their tier and the wanted one."""
    w = wanted.groupBy("ticker").agg(F.max(tier_rank(F.col("tier"))).alias("_w"))
    j = companies.join(w, "ticker", "left")
    return j.withColumn("tier", tier_name(F.greatest(tier_rank(F.col("tier")), F.coalesce("_w", F.lit(1))))).drop("_w")


def sync_tiers(companies: DataFrame, edges: DataFrame, mentions_key: str = "src") -> DataFrame:
    """ticker, tier, new_tier, change (raised, corrected, stale, same): `graph` for companies with knowledge edges; one without cik is always `metrics`."""
    n = edges.groupBy(F.col(mentions_key).alias("ticker")).agg(F.count(F.lit(1)).alias("edges"))
    j = companies.join(n, "ticker", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    has = F.col("edges") > 0
    new = F.when(F.col("cik").isNull(), "metrics").when(has, "graph").otherwise(F.col("tier"))
    change = F.when((F.col("cik").isNull()) & (F.col("tier") != "metrics"), "corrected").when(has & (F.col("tier") != "graph") & F.col("cik").isNotNull(), "raised").when(~has & (F.col("tier") == "graph"), "stale").otherwise("same")
    return j.select("ticker", "tier", new.alias("new_tier"), change.alias("change"))


def replace_source(old: DataFrame, new: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot replaced: (edges after, owners left without any edge)."""
    after = old.where(F.col("source") != source).unionByName(new.withColumn("source", F.lit(source)).select(*old.columns))
    orphans = old.select("owner").distinct().join(after.select("owner").distinct(), "owner", "left_anti")
    return after, orphans


def newer_only(candidates: DataFrame, have: DataFrame) -> DataFrame:
    """Candidates (ticker, fiscal_year, ...) newer than what is stored for the ticker."""
    top = have.groupBy("ticker").agg(F.max("fiscal_year").alias("_have"))
    return candidates.join(top, "ticker", "left").where(F.col("fiscal_year") > F.coalesce("_have", F.lit(0))).drop("_have")


def pending(wanted: DataFrame, attempted: DataFrame, key: str) -> DataFrame:
    """Keys to try: never attempted, or whose last attempt (column attempt) was an error; empty results count as done."""
    last = attempted.groupBy(key).agg(F.max_by("status", "attempt").alias("_s"))
    return wanted.join(last.where("_s <> 'error'"), key, "left_anti")


def counts_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, before, after, same: counters of a manifest against a restored store."""
    j = before.select("name", F.col("n").alias("before")).join(after.select("name", F.col("n").alias("after")), "name", "full_outer")
    return j.withColumn("same", F.col("before").eqNullSafe(F.col("after")))
