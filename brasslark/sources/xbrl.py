"""Annual company facts from filed JSON: currency, fiscal year, restatements, tag changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which tags stand for a metric, the preferred one first.
METRIC_TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"),
    "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "rnd_expense": ("ResearchAndDevelopmentExpense",),
    "sga_expense": ("SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "stockholders_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "eps_diluted": ("EarningsPerShareDiluted",),
}
#: Yearly forms, and the taxonomies whose facts win over the ones before.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
TAXONOMIES = ("ifrs-full", "us-gaap")
RECORD = "start string, end string, val double, accn string, fy int, fp string, form string"
SCHEMA = f"entityName string, facts map<string, map<string, struct<units: map<string, array<struct<{', '.join(f.replace(' ', ': ') for f in RECORD.split(', '))}>>>>>>"
YEAR_COLUMNS = ("ticker", "fiscal_year", "period_end", "accession", "currency", "derived")


def records(raw: DataFrame) -> DataFrame:
    """ticker, taxonomy, tag, unit and the fields of each filed record, from (ticker, json) rows; broken JSON gives none."""
    data = raw.select("ticker", F.from_json("json", SCHEMA).alias("d")).where("d is not null")
    tags = data.select("ticker", F.explode("d.facts").alias("taxonomy", "tags")).select("ticker", "taxonomy", F.explode("tags").alias("tag", "t"))
    units = tags.select("ticker", "taxonomy", "tag", F.explode("t.units").alias("unit", "r"))
    each = units.select("ticker", "taxonomy", "tag", "unit", F.posexplode("r").alias("pos", "r"))
    return each.select("ticker", "taxonomy", "tag", "unit", "pos", F.to_date("r.start").alias("start"), F.to_date("r.end").alias("end"), "r.val", "r.accn", "r.fy", "r.fp", "r.form")


def year_labels(rows: DataFrame) -> DataFrame:
    """ticker, end, label: a filing's `fy` belongs to its newest period; each end takes its label from there."""
    own = rows.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("fp") == "FY") & F.col("fy").isNotNull())
    per = own.groupBy("ticker", "accn").agg(F.max("end").alias("end"), F.max_by("fy", "end").alias("label"))
    return per.groupBy("ticker", "end").agg(F.max_by("label", "accn").alias("label"))


def majority_unit(rows: DataFrame) -> DataFrame:
    """The records in the unit that most records of the tag have; USD wins ties, then the first by name."""
    n = rows.groupBy("ticker", "taxonomy", "tag", "unit").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ticker", "taxonomy", "tag").orderBy(F.desc("n"), (F.col("unit") != "USD"), "unit")
    best = n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("ticker", "taxonomy", "tag", "unit")
    return rows.join(best, ["ticker", "taxonomy", "tag", "unit"])


def annual(rows: DataFrame) -> DataFrame:
    """One record a tag and fiscal year: yearly forms and periods of about a year; the newest filing restates the others."""
    length = F.datediff("end", "start")
    kept = rows.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("fp") == "FY") & F.col("end").isNotNull() & F.col("val").isNotNull() & (F.col("start").isNull() | length.between(300, 400)))
    named = kept.join(year_labels(rows), ["ticker", "end"], "left").withColumn("fiscal_year", F.coalesce("label", F.year("end")))
    w = Window.partitionBy("ticker", "taxonomy", "tag", "unit", "fiscal_year").orderBy(F.desc("accn"), F.desc("end"), "pos")
    return named.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_tags(rows: DataFrame) -> DataFrame:
    """One fact a metric and year: later taxonomies win, then the tag that stands first for the metric in that year."""
    spark = rows.sparkSession
    order = spark.createDataFrame([(m, t, i) for m, tags in METRIC_TAGS.items() for i, t in enumerate(tags)], "metric string, tag string, prio int")
    ranks = F.array_position(F.array(*[F.lit(t) for t in TAXONOMIES]), F.col("taxonomy"))
    w = Window.partitionBy("ticker", "metric", "fiscal_year").orderBy("prio", F.desc(ranks), "unit")
    best = rows.join(F.broadcast(order), "tag").withColumn("_r", F.row_number().over(w)).where("_r = 1")  # a fixed table of tags
    return best.select("ticker", "metric", "fiscal_year", F.col("val").alias("value"), "unit", F.regexp_replace("unit", "/.*", "").alias("currency"), "tag", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "form", F.col("accn").alias("accession"))


def facts(raw: DataFrame) -> DataFrame:
    """Tall annual facts from (ticker, json) rows."""
    rows = records(raw)
    known = [t for tags in METRIC_TAGS.values() for t in tags]
    return merge_tags(annual(majority_unit(rows.where(F.col("tag").isin(known)))))


def derive(years: DataFrame) -> DataFrame:
    """Fills gross_profit from revenue and cost where it is missing, and names it in `derived`."""
    missing = F.col("gross_profit").isNull() & F.col("revenue").isNotNull() & F.col("cost_of_revenue").isNotNull()
    gross = F.when(missing, F.col("revenue") - F.col("cost_of_revenue")).otherwise(F.col("gross_profit"))
    return years.withColumn("derived", F.when(missing, F.array(F.lit("gross_profit"))).otherwise(F.array().cast("array<string>"))).withColumn("gross_profit", gross)


def year_rows(tall: DataFrame) -> DataFrame:
    """Wide rows, one a ticker and year; period, accession and currency are those of revenue, or of any fact without it."""
    wide = tall.groupBy("ticker", "fiscal_year").pivot("metric", list(METRIC_TAGS)).agg(F.first("value"))
    lead = F.struct((F.col("metric") == "revenue").cast("int").alias("own"), F.col("metric"))
    about = tall.groupBy("ticker", "fiscal_year").agg(*[F.max_by(c, lead).alias(c) for c in ("period_end", "accession", "currency")])
    mixed = tall.where(F.col("metric").isin("revenue", "cost_of_revenue")).groupBy("ticker", "fiscal_year").agg(F.count_distinct("currency").alias("_c"))
    rows = derive(wide.join(about, ["ticker", "fiscal_year"]))
    rows = rows.join(mixed, ["ticker", "fiscal_year"], "left").withColumn("gross_profit", F.when((F.size("derived") > 0) & (F.col("_c") > 1), None).otherwise(F.col("gross_profit"))).drop("_c")
    return rows.withColumn("key", F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string"))).select("key", *YEAR_COLUMNS, *METRIC_TAGS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, json) from files of one JSON object each, named by ticker."""
    files = spark.read.text(path, wholetext=True).withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    return files.select("ticker", F.col("value").alias("json"))
