"""The concepts of the engine (companies, yearly figures, edges, ...) as views over the driver's tables.

The live sources of company data are network services, so queries run on stand-ins: suppliers are companies,
line items add up to yearly figures. Money is summed as DECIMAL, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factor on the retail price that makes losses rare but present.
COST_FACTOR = 1.85
METRICS = ("revenue", "cost_of_revenue", "gross_profit", "net_income", "stockholders_equity", "total_assets", "total_liabilities", "operating_cash_flow")
DOLLAR_REGIONS = ("AFRICA", "AMERICA", "ASIA")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey, ticker, name, sector, market, region, currency, acctbal: one row a supplier."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("suppkey"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("SEC"), (F.col("s_suppkey") % 5).cast("string")).alias("sector"),
            F.col("n_name").alias("market"),
            F.col("r_name").alias("region"),
            F.when(F.col("r_name").isin(*DOLLAR_REGIONS), "USD").otherwise("EUR").alias("currency"),
            F.col("s_acctbal").alias("acctbal"),
        )
    )


def wide_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, sector: one row a customer, with sparse years."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))


def _money(x) -> F.Column:
    return F.sum(x.cast("decimal(18,4)")).cast("double")


def fin_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per company and fiscal year: company columns, fiscal_year and METRICS."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    sales = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sums = lines.groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("fiscal_year")).agg(
        _money(sales).alias("revenue"),
        _money(F.col("l_quantity") * F.col("p_retailprice")).alias("cost"),
        _money(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        _money(F.when(F.col("l_returnflag") != "R", sales).otherwise(0.0)).alias("kept"),
        F.max("l_shipdate").cast("date").alias("period_end"),
    )
    cost = F.col("cost") * F.lit(COST_FACTOR)
    equity = F.col("acctbal") * F.lit(100.0)
    return (
        sums.join(companies(spark, sf_dir), "suppkey")
        .withColumn("cost_of_revenue", cost)
        .withColumn("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
        .withColumn("net_income", F.col("gross_profit") - F.col("tax"))
        .withColumn("stockholders_equity", equity)
        .withColumn("total_assets", F.abs("stockholders_equity") + F.col("revenue"))
        .withColumn("total_liabilities", F.col("total_assets") - F.col("stockholders_equity"))
        .withColumn("operating_cash_flow", F.col("kept") - F.col("cost_of_revenue"))
        .withColumn("operating_income", F.col("gross_profit") - F.col("tax") * 0.5)
        .withColumn("cash_and_equivalents", F.abs("acctbal") * 10.0)
        .select("suppkey", "ticker", "name", "sector", "market", "currency", "fiscal_year", "period_end", *METRICS, "operating_income", "cash_and_equivalents")
    )


def facts(years: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Tall: ticker, sector, currency, fiscal_year, metric, value; NULL values are left out."""
    return years.unpivot(["ticker", "sector", "currency", "fiscal_year"], list(metrics), "metric", "value").where("value is not null")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, owner, percent (a fraction): deterministic stakes among the companies, cycles included."""
    own = companies(spark, sf_dir).select("suppkey")
    n = own.agg(F.count(F.lit(1)).alias("n"))
    rows = own.crossJoin(F.broadcast(n)).select("suppkey", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j"))  # one row on the right
    first = own.agg(F.min("suppkey").alias("first"))
    rows = rows.crossJoin(F.broadcast(first)).select(
        F.col("suppkey").alias("company"),
        (F.pmod(F.col("suppkey") * 7 + F.col("j") * 17 + 3, F.col("n")) + F.col("first")).alias("owner"),
        (F.lit(0.02) + ((F.col("suppkey") * 31 + F.col("j") * 53) % 97) / F.lit(100.0)).alias("percent"),
        "j",
    )
    return rows.where("company <> owner").groupBy("company", "owner").agg(F.min_by("percent", "j").alias("percent"))


#: Line items a task where pairs are counted. Adaptive execution sizes tasks by compressed bytes, and an edge takes twenty times as many in memory.
LINES = 200_000


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks to which edges of `knowledge` are dealt, so that one has about LINES line items at any size; the rows are counted from the files' footers."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel, dst, mentions, confidence: company SUPPLIES customer, company OPERATES_IN market; keys with their label."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.select("l_suppkey", "o_custkey").repartition(edge_tasks(spark, sf_dir), "l_suppkey", "o_custkey")  # hardly two lines share a pair
    pairs = pairs.groupBy("l_suppkey", "o_custkey").agg(F.count(F.lit(1)).alias("mentions"))
    sells = pairs.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("CUSTOMER_OF").alias("rel"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("dst"), "mentions")
    place = companies(spark, sf_dir).select(F.col("ticker").alias("src"), F.lit("OPERATES_IN").alias("rel"), F.concat(F.lit("G:"), F.col("market")).alias("dst"), F.lit(1).cast("long").alias("mentions"))
    both = sells.unionByName(place)
    return both.withColumn("confidence", F.least(F.lit(1.0), F.col("mentions") / F.lit(4.0)))


#: The same views for the SQL twins.
COMPANIES_SQL = """
companies AS (
    SELECT s_suppkey AS suppkey, 'S' || s_suppkey AS ticker, s_name AS name, 'SEC' || (s_suppkey % 5) AS sector, n_name AS market, r_name AS region,
           CASE WHEN r_name IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'USD' ELSE 'EUR' END AS currency, s_acctbal AS acctbal
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
FIN_YEARS_SQL = (
    COMPANIES_SQL
    + """,
year_sums AS (
    SELECT l_suppkey AS suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
           CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(l_quantity * p_retailprice AS DECIMAL(18,4))) AS DOUBLE) * 1.85::DOUBLE AS cost_of_revenue,
           CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS tax,
           CAST(sum(CAST(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END AS DECIMAL(18,4))) AS DOUBLE) AS kept,
           CAST(max(l_shipdate) AS DATE) AS period_end
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
),
fin_years AS (
    SELECT suppkey, ticker, name, sector, market, currency, fiscal_year, period_end, revenue, cost_of_revenue, revenue - cost_of_revenue AS gross_profit,
           revenue - cost_of_revenue - tax AS net_income, acctbal * 100.0::DOUBLE AS stockholders_equity, abs(acctbal * 100.0::DOUBLE) + revenue AS total_assets,
           (abs(acctbal * 100.0::DOUBLE) + revenue) - acctbal * 100.0::DOUBLE AS total_liabilities, kept - cost_of_revenue AS operating_cash_flow,
           revenue - cost_of_revenue - tax * 0.5::DOUBLE AS operating_income, abs(acctbal) * 10.0::DOUBLE AS cash_and_equivalents
    FROM year_sums JOIN companies USING (suppkey)
)"""
)
OWNERSHIP_SQL = (
    COMPANIES_SQL
    + """,
ownership AS (
    SELECT company, owner, min_by(percent, j) AS percent FROM (
        SELECT suppkey AS company, (suppkey * 7 + j * 17 + 3) % (SELECT count(*) FROM companies) + (SELECT min(suppkey) FROM companies) AS owner,
               0.02::DOUBLE + ((suppkey * 31 + j * 53) % 97) / 100.0::DOUBLE AS percent, j
        FROM companies, range(1, 4) AS t(j)
    ) WHERE company <> owner GROUP BY company, owner
)"""
)
KNOWLEDGE_SQL = (
    COMPANIES_SQL
    + """,
knowledge AS (
    SELECT *, least(1.0::DOUBLE, mentions / 4.0::DOUBLE) AS confidence FROM (
        SELECT 'S' || l_suppkey AS src, 'CUSTOMER_OF' AS rel, 'C' || o_custkey AS dst, count(*) AS mentions
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
        UNION ALL SELECT ticker, 'OPERATES_IN', 'G:' || market, 1 FROM companies
    )
)"""
)
#: Chunks of text as the vectors' owners: most chunks are of companies that are there, some of none.
CHUNKS_SQL = "chunks AS (SELECT vec_id AS chunk_id, 'S' || (1 + vec_id * 7 % 60) AS ticker, 1992 + vec_id % 7 AS fiscal_year FROM embeddings)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, ticker, fiscal_year: one row a vector."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(vec.alias("chunk_id"), F.concat(F.lit("S"), (1 + vec * 7 % 60).cast("string")).alias("ticker"), (1992 + vec % 7).alias("fiscal_year"))
