"""Lists of companies, filings, holders and series as they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
EXCHANGES = ("Nasdaq", "NYSE", "CBOE")
MARKETS = ("HSX", "HNX", "UPCOM")


def tickers(raw: DataFrame) -> DataFrame:
    """ticker, cik, name, pos from (json) rows of an object of objects {cik_str, ticker, title}."""
    each = raw.select(F.from_json("json", "map<string, struct<cik_str: bigint, ticker: string, title: string>>").alias("m")).select(F.explode("m").alias("pos", "c"))
    return each.select(F.upper("c.ticker").alias("ticker"), F.lpad(F.col("c.cik_str").cast("string"), 10, "0").alias("cik"), F.col("c.title").alias("name"), F.col("pos").cast("int").alias("pos"))


def columnar(raw: DataFrame, *names: str) -> DataFrame:
    """The named columns, as strings, of {fields: [...], data: [[...]]}, found by their place in fields."""
    d = raw.select(F.from_json("json", "fields array<string>, data array<array<string>>").alias("d")).select("d.fields", F.explode("d.data").alias("row"))
    return d.select(*[F.get("row", (F.array_position("fields", n) - 1).cast("int")).alias(n) for n in names])


def full_universe(listed: DataFrame, exchanges: DataFrame, keep: tuple[str, ...] = EXCHANGES) -> DataFrame:
    """Listed companies on the exchanges kept, one ticker (the first published) a cik, by ticker."""
    on = exchanges.select(F.upper("ticker").alias("ticker"), "exchange").where(F.col("exchange").isin(*keep)).dropDuplicates(["ticker"])
    w = Window.partitionBy("cik").orderBy("pos", "ticker")
    return listed.join(on, "ticker").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "pos")


def seeds(universe: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the universe's rows for the tickers wanted, the tickers it does not have)."""
    return universe.join(wanted, "ticker", "left_semi"), wanted.join(universe, "ticker", "left_anti")


def filings(raw: DataFrame, forms: tuple[str, ...], limit: int) -> DataFrame:
    """The newest filings of each ticker from parallel arrays (form, accession, filing_date, period_end, document), with fiscal_year and doc_id."""
    names = ("form", "accession", "filing_date", "period_end", "document")
    each = raw.select("ticker", F.explode(F.arrays_zip(*names)).alias("f")).select("ticker", *[f"f.{n}" for n in names]).where(F.col("form").isin(*forms))
    each = each.withColumn("fiscal_year", F.substring(F.coalesce(F.nullif("period_end", F.lit("")), "filing_date"), 1, 4))
    each = each.withColumn("doc_id", F.concat_ws("_", "ticker", F.replace("form", F.lit("/"), F.lit("")), "fiscal_year"))
    w = Window.partitionBy("ticker").orderBy(F.desc("filing_date"), F.desc("accession"))
    return each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def market_companies(raw: DataFrame, keep: tuple[str, ...] = MARKETS) -> DataFrame:
    """ticker, symbol, name, exchange of companies on the markets kept; the first name that is not blank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(blank("name_full"), blank("name_short"), blank("name_local"), F.col("symbol"))
    return raw.where(F.col("exchange").isin(*keep)).select(F.concat("symbol", F.lit(".VN")).alias("ticker"), "symbol", name.alias("name"), "exchange")


def field_titles(raw: DataFrame) -> DataFrame:
    """section, field, title, pos from (json) rows of {section: [{field, title}]}."""
    m = raw.select(F.from_json("json", "map<string, array<struct<field: string, title: string>>>").alias("m")).select(F.explode("m").alias("section", "f"))
    return m.select("section", F.posexplode("f").alias("pos", "f")).select("section", "f.field", "f.title", "pos")


def resolve_fields(titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """metric, section, field: for (metric, section, candidate, rank) rows, an exact title beats a prefix, then the candidate's rank, then the field's place."""
    low = lambda c: F.lower(F.trim(c))
    j = candidates.join(titles, "section").where(low("title").startswith(low("candidate")))
    w = Window.partitionBy("metric", "section").orderBy((low("title") != low("candidate")), "rank", "pos")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("metric", "section", "field")


def statement_rows(statements: DataFrame, fields: DataFrame) -> DataFrame:
    """ticker, fiscal_year and metrics from tall statements (ticker, section, fiscal_year, field, value); expenses are positive."""
    j = statements.join(fields, ["section", "field"])
    value = F.when(F.col("metric").isin("cost_of_revenue", "sga_expense", "capex"), F.abs("value")).otherwise(F.col("value"))
    names = ["revenue", "cost_of_revenue", "gross_profit", "net_income", "total_assets", "total_liabilities", "stockholders_equity", "operating_cash_flow", "sga_expense", "capex"]
    return j.withColumn("value", value).groupBy("ticker", "fiscal_year").pivot("metric", names).agg(F.first("value"))


def shareholders(raw: DataFrame, least: float = 0.005) -> DataFrame:
    """Holders with a stake of `least` or more; persons are scoped to the company, organisations are shared."""
    person = F.col("kind") == "person"
    name = F.when(person, F.concat("owner", F.lit(" ("), "symbol", F.lit(")"))).otherwise(F.col("owner"))
    return raw.where(F.col("percent") >= least).select("ticker", name.alias("owner"), F.col("owner").alias("owner_raw"), F.when(person, "Person").otherwise("Organization").alias("owner_label"), "percent", "as_of")


def series(raw: DataFrame) -> DataFrame:
    """series_id, date, value; missing values are written as a point."""
    return raw.where(~F.trim("value").isin(".", "")).select("series_id", F.to_date("date").alias("date"), F.expr("try_cast(value AS double)").alias("value")).where("value is not null")


def latest_by_key(raw: DataFrame, key: str, order: str) -> DataFrame:
    """The last row a key of an append-only cache, errors left out."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return raw.where("error is null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def attach_sic(companies: DataFrame, sic: DataFrame) -> DataFrame:
    return companies.join(sic.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "sic", "sic_desc").dropDuplicates(["cik"]), "cik", "left")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of a JSON-lines file."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return rows.where("_corrupt is null").drop("_corrupt"), rows.where("_corrupt is not null").select("_corrupt")
