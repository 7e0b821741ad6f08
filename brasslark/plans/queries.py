"""The catalogue: each query over the driver's tables, and its SQL twin for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasslark import catalog as C
from brasslark.functions import numbers as N
from brasslark.functions import text as X
from brasslark.functions.reading import numbers_in
from brasslark.operators import documents, graph, joins, merges, resolve, triples, upserts, vector, windows
from brasslark.plans import financials, peers, scorecard, sessions, verify, watch
from brasslark.sources import xbrl
from brasslark.sources.scratch import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ints: str) -> Callable[[Query], Query]:
    """ints: columns that are INTEGER in Spark (ranks and row numbers), BIGINT in DuckDB."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ints)}) FROM ({sql})" if ints else sql
        return f

    return put


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.companies(spark, sf_dir).select("ticker")


YEARS, OWN, KNOW = f"WITH {C.FIN_YEARS_SQL}", f"WITH {C.OWNERSHIP_SQL}", f"WITH {C.KNOWLEDGE_SQL}"
OWNERSHIP_ONLY, KNOWLEDGE_ONLY = (sql.split("companies AS", 1)[1].split("),", 1)[1].strip() for sql in (C.OWNERSHIP_SQL, C.KNOWLEDGE_SQL))
#: Knowledge with the sentence it comes from, and stakes with their share and date; with the nodes of yearly figures, all edges.
EDGES = f"{KNOW}, {OWNERSHIP_ONLY}"
ALL_EDGES = f"""{YEARS}, {KNOWLEDGE_ONLY}, {OWNERSHIP_ONLY}, {C.CHUNKS_SQL},
edges AS (SELECT src, rel, dst, mentions, NULL::DOUBLE AS percent FROM knowledge UNION ALL SELECT 'S' || company, 'OWNED_BY', 'S' || owner, 1, percent FROM ownership
UNION ALL SELECT ticker, 'HAS_FINANCIALS', ticker || '|' || fiscal_year, 1, NULL FROM fin_years),
ends AS (SELECT src AS node, rel FROM edges UNION ALL SELECT dst, rel FROM edges),
degrees AS (SELECT node, count(*) FILTER (rel NOT IN ('OWNED_BY', 'HAS_FINANCIALS')) AS knowledge, count(*) FILTER (rel = 'OWNED_BY') AS ownership, count(*) FILTER (rel = 'HAS_FINANCIALS') AS infra FROM ends GROUP BY node),
per AS (SELECT ticker, count(*) AS years, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM fin_years WHERE fiscal_year BETWEEN 1990 AND 2100 GROUP BY ticker),
texts AS (SELECT ticker, count(*) AS chunks FROM chunks GROUP BY ticker),
cover AS (SELECT c.ticker, coalesce(years, 0) AS years, first_year, last_year, coalesce(knowledge, 0) AS knowledge, coalesce(ownership, 0) AS ownership, coalesce(chunks, 0) AS chunks
FROM companies c LEFT JOIN per USING (ticker) LEFT JOIN degrees d ON d.node = c.ticker LEFT JOIN texts USING (ticker))"""


def told_edges(spark, sf_dir):
    told = C.knowledge(spark, sf_dir).withColumn("evidence", F.concat_ws(" ", "src", "rel", "dst")).withColumn("doc_id", F.concat("src", F.lit("_10-K"))).withColumn("percent", F.lit(None).cast("double")).withColumn("as_of", F.lit(None).cast("string"))
    code = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    stakes = C.ownership(spark, sf_dir).select(code("company").alias("src"), F.lit("OWNED_BY").alias("rel"), code("owner").alias("dst"), F.lit(1).cast("long").alias("mentions"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("doc_id"), "percent", F.lit("2001-12-31").alias("as_of"))
    return told.unionByName(stakes)


def all_edges(spark, sf_dir, years):
    own = years.select(F.col("ticker").alias("src"), F.lit("HAS_FINANCIALS").alias("rel"), F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string")).alias("dst"), F.lit(1).cast("long").alias("mentions"))
    return told_edges(spark, sf_dir).unionByName(own, allowMissingColumns=True)


# Figures


@query(f"""{YEARS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r FROM fin_years)
SELECT ticker, fiscal_year, currency, 'revenue' AS metric, revenue AS value FROM ranked WHERE r <= 3
UNION ALL SELECT ticker, fiscal_year, currency, 'net_income', net_income FROM ranked WHERE r <= 3""")
def lookup_financials(spark, sf_dir):
    return financials.lookup(C.fin_years(spark, sf_dir), every(spark, sf_dir), ["revenue", "net_income", "no_such_metric"], limit=3)


@query(f"""{YEARS} SELECT fiscal_year, currency, ticker, net_income AS value,
row_number() OVER (PARTITION BY fiscal_year, currency ORDER BY net_income DESC, ticker) AS place,
min(currency) OVER (PARTITION BY fiscal_year) <> max(currency) OVER (PARTITION BY fiscal_year) AS mixed FROM fin_years""", "place")
def compare_metric(spark, sf_dir):
    return financials.compare(C.fin_years(spark, sf_dir), every(spark, sf_dir), "net_income")


@query(f"""{YEARS} SELECT ticker, name, fiscal_year, currency, revenue, net_income FROM fin_years
WHERE fiscal_year = 1997 AND currency = 'USD' AND net_income > 0 AND revenue >= 100000 ORDER BY revenue DESC, ticker LIMIT 20""")
def screen_companies(spark, sf_dir):
    return financials.screen(C.fin_years(spark, sf_dir), [("net_income", "gt", 0), ("revenue", "gte", 100_000), ("bad", "gt", 1)], 1997, "revenue")


@query(f"""{YEARS} SELECT CASE WHEN currency <> 'USD' THEN 'other_currency' WHEN net_income > 0 THEN 'kept' ELSE 'filtered' END AS reason, count(*) AS n
FROM fin_years WHERE fiscal_year = 1997 GROUP BY ALL""")
def screen_dropped(spark, sf_dir):
    return financials.screened_out(C.fin_years(spark, sf_dir), [("net_income", "gt", 0)], 1997)


@query("""WITH have AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) SELECT 'C' || c_custkey AS ticker FROM customer ANTI JOIN have ON c_custkey = o_custkey""")
def missing_metric_anti(spark, sf_dir):
    orders = C.table(spark, sf_dir, "orders")
    years = orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_totalprice").alias("revenue"))
    return financials.missing(years, C.wide_companies(spark, sf_dir), "revenue", 1997)


@query(f"{YEARS} SELECT currency, count(*) AS n, count(DISTINCT ticker) AS companies FROM fin_years GROUP BY currency")
def currency_counts(spark, sf_dir):
    return C.fin_years(spark, sf_dir).groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("companies"))


@query(f"{ALL_EDGES} SELECT * FROM cover")
def coverage_summary(spark, sf_dir):
    years = saved(C.fin_years(spark, sf_dir), "years")
    return financials.coverage(C.companies(spark, sf_dir), years, all_edges(spark, sf_dir, years), vector.indexed(C.chunks(spark, sf_dir)).select("ticker", "chunks"))


@query(f"""{YEARS}, top AS (SELECT currency, ticker, max(revenue) AS revenue FROM fin_years WHERE fiscal_year >= 1997 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY revenue DESC, ticker) AS place FROM top) SELECT * FROM ranked WHERE place <= 10""", "place")
def top_revenue_since(spark, sf_dir):
    return financials.top_revenue(C.fin_years(spark, sf_dir), 1997, 10)


@query(f"""{ALL_EDGES}, years AS (SELECT ticker, string_agg(fiscal_year || ':' || CAST(floor(revenue) AS BIGINT), ',' ORDER BY fiscal_year DESC) AS figures FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r FROM fin_years) WHERE r <= 5 GROUP BY ticker),
stakes AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY percent DESC NULLS LAST, dst) AS h, row_number() OVER (PARTITION BY dst ORDER BY percent DESC NULLS LAST, src) AS o FROM edges WHERE rel = 'OWNED_BY'),
holders AS (SELECT src AS ticker, string_agg(dst, ',' ORDER BY h) AS holders FROM stakes WHERE h <= 8 GROUP BY src), holdings AS (SELECT dst AS ticker, string_agg(src, ',' ORDER BY o) AS holdings FROM stakes WHERE o <= 8 GROUP BY dst),
business AS (SELECT src AS ticker, string_agg(rel || ':' || dst, ',' ORDER BY r) AS relations FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY mentions DESC, rel, dst) AS r FROM knowledge) WHERE r <= 8 GROUP BY src),
text AS (SELECT ticker, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY r) AS text FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, chunk_id) AS r FROM chunks) WHERE r <= 4 GROUP BY ticker),
newest AS (SELECT *, max(fiscal_year) OVER (PARTITION BY ticker) AS y FROM fin_years), placed AS (SELECT ticker, 'revenue:' || rank() OVER (PARTITION BY sector, currency, fiscal_year ORDER BY revenue DESC) || '/' || count(*) OVER (PARTITION BY sector, currency, fiscal_year) AS peers FROM newest WHERE fiscal_year = y)
SELECT c.ticker, name, years, first_year, last_year, knowledge, ownership, chunks, figures, holders, holdings, relations, text, peers,
concat_ws(',', CASE WHEN years = 0 THEN 'no_figures' END, CASE WHEN knowledge = 0 THEN 'no_relations' END, CASE WHEN ownership = 0 THEN 'no_owners' END, CASE WHEN chunks = 0 THEN 'no_text' END) AS gaps
FROM companies c JOIN cover USING (ticker) LEFT JOIN years USING (ticker) LEFT JOIN holders USING (ticker) LEFT JOIN holdings USING (ticker) LEFT JOIN business USING (ticker) LEFT JOIN text USING (ticker) LEFT JOIN placed USING (ticker)""")
def company_brief(spark, sf_dir):
    """Peers are the companies of the sector and currency in the company's newest year."""
    years = saved(C.fin_years(spark, sf_dir), "years")
    newest = years.join(years.groupBy("ticker").agg(F.max("fiscal_year").alias("y")), "ticker").where("fiscal_year = y")
    peers_of = windows.rank_in(newest, ["sector", "currency", "fiscal_year"], "revenue").select("ticker", F.lit("revenue").alias("metric"), "rank", "n")
    rows = financials.brief(C.companies(spark, sf_dir), years, saved(all_edges(spark, sf_dir, years), "edges"), C.chunks(spark, sf_dir), peers_of)
    told = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    text = lambda c: c.cast("string")
    return rows.select(
        "ticker", "name", "years", "first_year", "last_year", "knowledge", "ownership", "chunks", told("figures", lambda x: F.concat_ws(":", text(x["fiscal_year"]), text(F.floor(x["revenue"])))),
        told("holders", lambda x: x["dst"]), told("holdings", lambda x: x["src"]), told("relations", lambda x: F.concat_ws(":", x["rel"], x["dst"])), told("text", lambda x: text(x["chunk_id"])),
        told("peers", lambda x: F.concat(x["metric"], F.lit(":"), text(x["rank"]), F.lit("/"), text(x["n"]))), F.array_join("gaps", ",").alias("gaps"),
    )


@query(f"""{YEARS} SELECT ticker, fiscal_year, revenue, CASE WHEN py = fiscal_year - 1 THEN pv END AS prev,
round(CASE WHEN py = fiscal_year - 1 AND pv <> 0 THEN (revenue - pv) * 100.0 / abs(pv) END, 6) AS growth_pct
FROM (SELECT *, lag(fiscal_year) OVER w AS py, lag(revenue) OVER w AS pv FROM fin_years WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))""")
def yoy_growth(spark, sf_dir):
    return windows.growth(C.fin_years(spark, sf_dir), "revenue").select("ticker", "fiscal_year", "revenue", "prev", F.round("growth_pct", 6).alias("growth_pct"))


@query(f"""{YEARS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r FROM fin_years),
ends AS (SELECT ticker, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, min_by(revenue, fiscal_year) AS a, max_by(revenue, fiscal_year) AS b FROM ranked WHERE r <= 5 GROUP BY ticker)
SELECT ticker, first_year, last_year, a AS first_value, b AS last_value,
round(CASE WHEN a > 0 AND b > 0 AND last_year > first_year THEN (power(b / a, 1.0::DOUBLE / (last_year - first_year)) - 1) * 100 END, 6) AS cagr_pct, round((b - a) * 100.0 / abs(a), 6) AS change_pct FROM ends""")
def cagr_window(spark, sf_dir):
    return windows.span(C.fin_years(spark, sf_dir), "revenue", 5).withColumn("cagr_pct", F.round("cagr_pct", 6)).withColumn("change_pct", F.round("change_pct", 6))


@query("""WITH ranked AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM ranked WHERE r = 1""")
def latest_restated(spark, sf_dir):
    lines = C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    return windows.latest(lines, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_suppkey"), F.desc("l_partkey")]).drop("l_shipdate")


@query("""WITH per AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders),
labels AS (SELECT o_custkey, d, max(o_orderkey) AS k FROM per WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT o_orderkey, coalesce(k, CAST(year(p.d) AS BIGINT)) AS label FROM per p LEFT JOIN labels l ON p.o_custkey = l.o_custkey AND p.d = l.d""")
def fiscal_label_asof(spark, sf_dir):
    per = C.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    labels = per.where("o_orderkey % 3 = 0").groupBy("o_custkey", "d").agg(F.max("o_orderkey").alias("k"))
    return per.join(labels, ["o_custkey", "d"], "left").select("o_orderkey", F.coalesce("k", F.year("d").cast("long")).alias("label"))


@query("""WITH tagged AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, l_returnflag AS tag, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS prio, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, fiscal_year ORDER BY prio) AS r FROM tagged) SELECT l_suppkey, fiscal_year, tag, v AS value FROM ranked WHERE r = 1""")
def tag_priority_merge(spark, sf_dir):
    prio = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = C.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year"), F.col("l_returnflag").alias("tag")).agg(F.max("l_quantity").alias("value"), F.min(prio).alias("prio"))
    return windows.latest(rows, ["l_suppkey", "fiscal_year"], [F.col("prio")]).drop("prio")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority AS unit, count(*) AS n FROM orders GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, unit <> '1-URGENT', unit) AS r FROM n) SELECT o_custkey, unit, n FROM ranked WHERE r = 1""")
def unit_majority(spark, sf_dir):
    n = C.table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return windows.latest(n, ["o_custkey"], [F.desc("n"), F.col("unit") != "1-URGENT", F.col("unit")])


@query(f"{YEARS} SELECT ticker, max(revenue) FILTER (fiscal_year = 1996) AS y1996, max(revenue) FILTER (fiscal_year = 1997) AS y1997, max(revenue) FILTER (fiscal_year = 1998) AS y1998 FROM fin_years GROUP BY ticker")
def pivot_year_rows(spark, sf_dir):
    wide = C.fin_years(spark, sf_dir).groupBy("ticker").pivot("fiscal_year", [1996, 1997, 1998]).agg(F.first("revenue"))
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in (1996, 1997, 1998)})


@query(f"""{YEARS} UNPIVOT (SELECT ticker, sector, currency, fiscal_year, revenue, net_income, stockholders_equity FROM fin_years) ON revenue, net_income, stockholders_equity INTO NAME metric VALUE value""")
def unpivot_facts(spark, sf_dir):
    return C.facts(C.fin_years(spark, sf_dir), ("revenue", "net_income", "stockholders_equity"))


@query(f"""{YEARS}, holes AS (SELECT ticker, fiscal_year, revenue, cost_of_revenue, CASE WHEN fiscal_year % 2 = 0 THEN gross_profit END AS gross_profit FROM fin_years)
SELECT ticker, fiscal_year, coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit, gross_profit IS NULL AS was_derived FROM holes""")
def derive_gross_profit(spark, sf_dir):
    holes = C.fin_years(spark, sf_dir).withColumn("gross_profit", F.when(F.col("fiscal_year") % 2 == 0, F.col("gross_profit")))
    return xbrl.derive(holes).select("ticker", "fiscal_year", "gross_profit", (F.size("derived") > 0).alias("was_derived"))


# Peers and scorecard

RATIOS = """ratios AS (SELECT *, net_income * 100.0 / nullif(revenue, 0) AS net_margin, gross_profit * 100.0 / nullif(revenue, 0) AS gross_margin,
CASE WHEN stockholders_equity > 0 THEN net_income * 100.0 / stockholders_equity END AS roe, revenue / nullif(total_assets, 0) AS asset_turnover FROM fin_years)"""


@query(f"""{YEARS}, {RATIOS} SELECT ticker, fiscal_year, round(net_margin, 6) AS net_margin, round(gross_margin, 6) AS gross_margin, round(roe, 6) AS roe, round(asset_turnover, 6) AS asset_turnover FROM ratios""")
def peer_ratios(spark, sf_dir):
    return peers.ratios(C.fin_years(spark, sf_dir)).select("ticker", "fiscal_year", *[F.round(c, 6).alias(c) for c in peers.RATIOS])


@query(f"""{YEARS}, {RATIOS}, known AS (SELECT * FROM ratios WHERE roe IS NOT NULL)
SELECT ticker, sector, currency, fiscal_year, rank() OVER (w ORDER BY roe DESC) AS rank, count(*) OVER w AS n,
round((count(*) OVER w - rank() OVER (w ORDER BY roe DESC)) * 100.0 / nullif(count(*) OVER w - 1, 0), 6) AS percentile FROM known WINDOW w AS (PARTITION BY sector, currency, fiscal_year)""", "rank")
def peer_rank(spark, sf_dir):
    rows = windows.rank_in(peers.ratios(C.fin_years(spark, sf_dir)), ["sector", "currency", "fiscal_year"], "roe")
    return rows.select("ticker", "sector", "currency", "fiscal_year", "rank", "n", F.round("percentile", 6).alias("percentile"))


@query(f"""{YEARS}, ranked AS (SELECT sector, currency, fiscal_year, revenue, row_number() OVER (w ORDER BY revenue) AS r, count(*) OVER w AS n FROM fin_years WINDOW w AS (PARTITION BY sector, currency, fiscal_year))
SELECT sector, currency, fiscal_year, revenue AS upper_median, n FROM ranked WHERE r = n // 2 + 1""")
def peer_upper_median(spark, sf_dir):
    return C.fin_years(spark, sf_dir).groupBy("sector", "currency", "fiscal_year").agg(windows.upper_median("revenue").alias("upper_median"), F.count(F.lit(1)).alias("n"))


@query(f"""{YEARS}, {RATIOS} SELECT ticker, fiscal_year, round(CASE WHEN roe IS NOT NULL AND count(roe) OVER w >= 5 THEN (rank() OVER (w ORDER BY roe NULLS LAST) - 1) * 100.0 / count(roe) OVER w END, 6) AS below
FROM ratios WINDOW w AS (PARTITION BY sector, currency, fiscal_year)""")
def sector_percentile(spark, sf_dir):
    rows = peers.ratios(C.fin_years(spark, sf_dir))
    return windows.with_share_below(rows, ["sector", "currency", "fiscal_year"], "roe", "below").select("ticker", "fiscal_year", F.round("below", 6).alias("below"))


#: Two markets that mix currencies, in place of the companies' own.
MARKET = "CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'X' ELSE 'Y' END"
PEERS = f"""peer_rows AS (SELECT a.ticker AS subject, b.ticker, a.currency AS own, b.currency FROM (SELECT *, {MARKET} AS m FROM companies) a JOIN (SELECT *, {MARKET} AS m FROM companies) b ON a.sector = b.sector AND a.m = b.m AND a.ticker <> b.ticker),
kept AS (SELECT subject, ticker FROM peer_rows WHERE own = currency)"""


def no_rivals(spark):
    return spark.createDataFrame([], "subject string, ticker string")


def peer_companies(spark, sf_dir):
    return C.companies(spark, sf_dir).withColumn("market", F.expr(MARKET))


@query(f"{YEARS}, {PEERS} SELECT subject, count(*) FILTER (own = currency) AS kept, count(*) FILTER (own <> currency) AS dropped FROM peer_rows GROUP BY subject")
def same_currency_dropped(spark, sf_dir):
    return peers.currency_counts(every(spark, sf_dir), peer_companies(spark, sf_dir), no_rivals(spark))


@query(f"""{YEARS}, {PEERS}, n AS (SELECT subject, count(*) AS total FROM kept GROUP BY subject),
have AS (SELECT subject, fiscal_year, count(*) AS peers FROM kept JOIN fin_years USING (ticker) GROUP BY ALL),
own AS (SELECT y.ticker AS subject, y.fiscal_year, total, coalesce(h.peers, 0) AS peers FROM fin_years y JOIN n ON y.ticker = n.subject LEFT JOIN have h ON h.subject = y.ticker AND h.fiscal_year = y.fiscal_year),
ranked AS (SELECT *, peers >= greatest(3, total // 2) AS fits FROM own), best AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, fiscal_year DESC) AS r FROM ranked)
SELECT subject, fiscal_year, peers, NOT fits AS warned FROM best WHERE r = 1""")
def best_comparison_year(spark, sf_dir):
    return peers.comparison_years(every(spark, sf_dir), peer_companies(spark, sf_dir), saved(C.fin_years(spark, sf_dir), "years"), no_rivals(spark))


@query(f"""{YEARS}, {RATIOS}, {PEERS}, n AS (SELECT subject, count(*) AS p FROM kept GROUP BY subject HAVING count(*) >= 3),
have AS (SELECT subject, fiscal_year, count(*) AS peers FROM kept JOIN fin_years USING (ticker) GROUP BY ALL),
own AS (SELECT y.ticker AS subject, y.fiscal_year, n.p, coalesce(h.peers, 0) AS peers FROM fin_years y JOIN n ON y.ticker = n.subject LEFT JOIN have h ON h.subject = y.ticker AND h.fiscal_year = y.fiscal_year),
chosen AS (SELECT subject, fiscal_year FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN peers >= greatest(3, p // 2) THEN 0 ELSE 1 END, fiscal_year DESC) AS r FROM own) WHERE r = 1),
pool AS (SELECT subject, ticker FROM kept UNION ALL SELECT subject, subject FROM n),
tall AS (UNPIVOT (SELECT subject, ticker, fiscal_year, net_margin, gross_margin, roe, asset_turnover, revenue FROM pool JOIN chosen USING (subject) JOIN ratios USING (ticker, fiscal_year)) ON net_margin, gross_margin, roe, asset_turnover, revenue INTO NAME metric VALUE value),
ranked AS (SELECT *, rank() OVER (w ORDER BY value DESC) AS rank, count(*) OVER w AS n, row_number() OVER (w ORDER BY value) AS r FROM tall WINDOW w AS (PARTITION BY subject, metric)),
middle AS (SELECT subject, metric, value AS upper_median FROM ranked WHERE r = n // 2 + 1)
SELECT subject, 'ok' AS status, metric, round(value, 6) AS value, rank, n, round((n - rank) * 100.0 / nullif(n - 1, 0), 6) AS percentile, round(upper_median, 6) AS upper_median, fiscal_year FROM ranked JOIN middle USING (subject, metric) WHERE subject = ticker
UNION ALL SELECT ticker, 'too_few_peers', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM companies WHERE ticker NOT IN (SELECT subject FROM n)""", "rank")
def peer_benchmark(spark, sf_dir):
    rows = peers.benchmark(every(spark, sf_dir), peer_companies(spark, sf_dir), saved(C.fin_years(spark, sf_dir), "years"), no_rivals(spark))
    return rows.withColumns({c: F.round(c, 6) for c in ("value", "percentile", "upper_median")})


#: Sectors with industry codes, and what rises of a series do to sectors. SEC4 has neither, the one series of SEC3 no data.
CODE_RANGES = [("SEC1", 0, 999), ("SEC1", 2000, 2999), ("SEC2", 3000, 5999), ("SEC3", 900, 2100)]
SERIES_WEIGHTS = [("SEC0", "1-URGENT", -1.0), ("SEC0", "2-HIGH", 0.5), ("SEC1", "3-MEDIUM", 1.0), ("SEC1", "4-NOT SPECIFIED", 1.0), ("SEC3", "9-NONE", 1.0)]

INDUSTRY = f"""codes AS (SELECT ticker, (suppkey * 37) % 9000 AS code FROM companies), ranges AS (SELECT * FROM (VALUES {", ".join(map(str, CODE_RANGES))}) t(sector, lo, hi)),
last AS (SELECT ticker, revenue, net_income * 100.0 / nullif(revenue, 0) AS margin, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, fiscal_year DESC) AS r FROM fin_years),
two AS (SELECT ticker, (max(revenue) FILTER (r = 1) - max(revenue) FILTER (r = 2)) * 100.0 / abs(max(revenue) FILTER (r = 2)) AS g, max(margin) FILTER (r = 1) - max(margin) FILTER (r = 2) AS m FROM last WHERE r <= 2 GROUP BY ticker),
industry_placed AS (SELECT DISTINCT ticker, sector FROM codes JOIN ranges ON code BETWEEN lo AND hi), industry_rows AS (SELECT sector, g, m, abs(g) > 150 AS out FROM industry_placed JOIN two USING (ticker) WHERE g IS NOT NULL),
industry_per AS (SELECT sector, count(*) AS companies, count(*) FILTER (out) AS outliers, median(g) FILTER (NOT out) AS growth, median(m) FILTER (NOT out) AS margin_change FROM industry_rows GROUP BY sector),
industry_scores AS (SELECT *, 0.6 * greatest(0, least(100, (growth + 10) / 30.0 * 100)) + 0.4 * greatest(0, least(100, (margin_change + 5) / 10.0 * 100)) AS score FROM industry_per)"""

MACRO = """obs AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY ALL),
newest AS (SELECT series_id, max_by(value, date) AS latest, max(date) AS latest_date FROM obs WHERE date <= DATE '2000-01-01' GROUP BY series_id),
base AS (SELECT o.series_id, max_by(o.value, o.date) AS base FROM obs o JOIN newest n USING (series_id) WHERE o.date <= n.latest_date - 182 GROUP BY o.series_id),
limits AS (SELECT * FROM (VALUES ('1-URGENT', 'pp', 50000.0::DOUBLE, 20000), ('2-HIGH', '%', 30.0::DOUBLE, 20000), ('3-MEDIUM', '%', 15.0::DOUBLE, 20000), ('4-NOT SPECIFIED', '%', 8.0::DOUBLE, 1), ('9-NONE', '%', 1.0::DOUBLE, 1)) t(series_id, unit, full_change, max_age)),
sig AS (SELECT l.series_id, latest, base, CASE WHEN latest IS NULL THEN 'no_data' WHEN DATE '2000-01-01' - latest_date > max_age THEN 'stale' WHEN base IS NULL THEN 'short_history' ELSE 'ok' END AS status,
CASE WHEN unit = 'pp' THEN latest - base ELSE (latest - base) * 100.0 / abs(base) END AS raw, full_change FROM limits l LEFT JOIN newest USING (series_id) LEFT JOIN base USING (series_id)),
signals AS (SELECT series_id, status, latest, base, CASE WHEN status = 'ok' THEN raw END AS change, CASE WHEN status = 'ok' THEN greatest(-1.0, least(1.0, raw / full_change)) END AS signal FROM sig),
series_weights AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', {w}::DOUBLE)" for a, b, w in SERIES_WEIGHTS) + """) t(sector, series_id, weight)),
macro_scores AS (SELECT sector, 50 + 50 * sum(weight * signal) FILTER (status = 'ok') / sum(abs(weight)) FILTER (status = 'ok') AS score, count(*) FILTER (status = 'ok') AS used, count(*) FILTER (status <> 'ok') AS dropped FROM series_weights JOIN signals USING (series_id) GROUP BY sector)"""


def macro(spark, sf_dir):
    """Signals of the series."""
    obs = C.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
    obs = obs.agg((F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("value"))
    limits = spark.createDataFrame([("1-URGENT", "pp", 50000.0, 20000), ("2-HIGH", "%", 30.0, 20000), ("3-MEDIUM", "%", 15.0, 20000), ("4-NOT SPECIFIED", "%", 8.0, 1), ("9-NONE", "%", 1.0, 1)], "series_id string, unit string, full double, max_age int")
    return scorecard.series_signals(obs, limits, F.lit("2000-01-01").cast("date"))


def by_macro(spark, sf_dir):
    return scorecard.macro_scores(macro(spark, sf_dir), spark.createDataFrame(SERIES_WEIGHTS, "sector string, series_id string, weight double"))


def by_industry(spark, sf_dir):
    codes = C.companies(spark, sf_dir).select("ticker", ((F.col("suppkey") * 37) % 9000).alias("code"))
    return scorecard.industry_scores(C.fin_years(spark, sf_dir), codes, spark.createDataFrame(CODE_RANGES, "sector string, lo long, hi long"))


@query(f"""{YEARS}, r AS (SELECT sector, currency, fiscal_year, row_number() OVER w AS place, ticker, revenue, greatest(count(*) OVER (PARTITION BY sector, currency, fiscal_year) - 10, 0) AS rest
FROM fin_years WINDOW w AS (PARTITION BY sector, currency, fiscal_year ORDER BY revenue DESC, ticker)) SELECT * FROM r WHERE place <= 10""", "place")
def peer_table(spark, sf_dir):
    return peers.table(saved(C.fin_years(spark, sf_dir), "years"), ["sector", "currency", "fiscal_year"])


#: Two sectors in place of banks and insurers.
PROFILE = "CASE sector WHEN 'SEC0' THEN 'bank' WHEN 'SEC1' THEN 'insurer' ELSE 'ordinary' END"


def to_scale(x: str, worst: float, best: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(100.0, (({x}) - {worst}) / ({best} - {worst})::DOUBLE * 100)) END"


GROUPS = f"""{INDUSTRY}, {MACRO}, groups_base AS (SELECT *, {PROFILE} AS profile, CASE WHEN revenue > 0 THEN net_income * 100.0 / revenue END AS margin,
CASE WHEN stockholders_equity > 0 THEN net_income * 100.0 / stockholders_equity END AS roe FROM fin_years), placed AS (SELECT *,
CASE WHEN roe IS NOT NULL AND count(roe) OVER w >= 5 THEN (rank() OVER (w ORDER BY roe NULLS LAST) - 1) * 100.0 / count(roe) OVER w END AS roe_pct,
CASE WHEN margin IS NOT NULL AND count(margin) OVER w >= 5 THEN (rank() OVER (w ORDER BY margin NULLS LAST) - 1) * 100.0 / count(margin) OVER w END AS margin_pct,
row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS back FROM groups_base WINDOW w AS (PARTITION BY sector, currency, fiscal_year)),
per AS (SELECT ticker, sector, currency, profile, max(fiscal_year) AS latest_year, count(*) AS n_years, min_by(revenue, fiscal_year) FILTER (back <= 5) AS rev0, max_by(revenue, fiscal_year) AS rev1,
min_by(net_income, fiscal_year) FILTER (back <= 5) AS ni0, max_by(net_income, fiscal_year) AS ni1, max(fiscal_year) - min(fiscal_year) FILTER (back <= 5) AS span,
max(roe) FILTER (back = 1) AS roe, max(roe_pct) FILTER (back = 1) AS roe_pct, max(margin_pct) FILTER (back = 1) AS margin_pct, max_by(stockholders_equity, fiscal_year) AS se, max_by(total_liabilities, fiscal_year) AS tl,
max_by(total_assets, fiscal_year) AS ta, max_by(operating_income, fiscal_year) AS oi, max_by(cash_and_equivalents, fiscal_year) AS cash,
avg(operating_cash_flow / net_income) FILTER (back <= 3 AND net_income > 0) AS conversion, count(*) FILTER (net_income < 0) AS losses,
count(margin) FILTER (back <= 5) AS nm, avg(margin) FILTER (back <= 5) AS mm, stddev_pop(margin) FILTER (back <= 5) AS sm FROM placed GROUP BY ALL),
parts AS (SELECT *, {to_scale("CASE WHEN rev0 > 0 AND rev1 > 0 AND span > 0 THEN (power(rev1 / rev0, 1.0::DOUBLE / span) - 1) * 100 END", -10, 20)} AS g1,
CASE WHEN ni1 <= 0 THEN 0.0 WHEN ni0 <= 0 AND ni1 > 0 THEN 60.0 ELSE {to_scale("CASE WHEN ni0 > 0 AND ni1 > 0 AND span > 0 THEN (power(ni1 / ni0, 1.0::DOUBLE / span) - 1) * 100 END", -15, 25)} END AS g2,
CASE WHEN se <= 0 THEN 0.0 WHEN profile = 'bank' THEN {to_scale("roe", 5, 20)} WHEN profile = 'insurer' THEN {to_scale("roe", 3, 15)} ELSE {to_scale("roe", 0, 20)} END AS p1,
CASE WHEN profile = 'bank' THEN {to_scale("ni1 * 100.0 / nullif(ta, 0)", 0.5, 2.0)} ELSE margin_pct END AS p3,
CASE WHEN se <= 0 THEN 0.0 ELSE {to_scale("tl / nullif(se, 0)", 3, 0.5)} END AS h1, {to_scale("cash * 100.0 / nullif(ta, 0)", 0, 15)} AS h2,
CASE profile WHEN 'bank' THEN {to_scale("se * 100.0 / nullif(ta, 0)", 5, 12)} WHEN 'insurer' THEN {to_scale("se * 100.0 / nullif(ta, 0)", 10, 35)} END AS h3,
{to_scale("conversion", 0, 1.2)} AS e1, CASE WHEN ni1 > 0 THEN {to_scale("oi / ni1", 0.6, 1.0)} END AS e2,
CASE losses WHEN 0 THEN 100.0 WHEN 1 THEN 50.0 ELSE 0.0 END AS s1, {to_scale("CASE WHEN nm >= 4 AND mm > 0 THEN sm / mm END", 1.0, 0.15)} AS s2 FROM per),
grp AS (SELECT ticker, sector, currency, profile, latest_year, rev1, ni1, se, CASE WHEN n_years >= 3 THEN list_avg(list_filter([g1, g2], lambda x: x IS NOT NULL)) END AS growth,
list_avg(list_filter([p1, roe_pct, p3], lambda x: x IS NOT NULL)) AS profitability, CASE WHEN profile = 'ordinary' THEN list_avg(list_filter([h1, h2], lambda x: x IS NOT NULL)) ELSE h3 END AS health,
list_avg(list_filter([e1, e2], lambda x: x IS NOT NULL)) AS earnings_quality, CASE WHEN n_years >= 3 THEN list_avg(list_filter([s1, s2], lambda x: x IS NOT NULL)) END AS stability FROM parts),
known AS (SELECT g.*, i.score AS industry, m.score AS macro FROM grp g LEFT JOIN industry_scores i USING (sector) LEFT JOIN macro_scores m USING (sector)),
t AS (SELECT *, CASE WHEN growth IS NOT NULL THEN 20.0 ELSE 0 END + CASE WHEN profitability IS NOT NULL THEN 20.0 ELSE 0 END + CASE WHEN health IS NOT NULL THEN 15.0 ELSE 0 END
 + CASE WHEN profile = 'ordinary' AND earnings_quality IS NOT NULL THEN 10.0 ELSE 0 END + CASE WHEN stability IS NOT NULL THEN 10.0 ELSE 0 END
 + CASE WHEN industry IS NOT NULL THEN 10.0 ELSE 0 END + CASE WHEN macro IS NOT NULL THEN 15.0 ELSE 0 END AS used, CASE WHEN profile <> 'ordinary' THEN 90.0 ELSE 100.0 END AS possible,
 coalesce(growth * 20, 0) + coalesce(profitability * 20, 0) + coalesce(health * 15, 0) + CASE WHEN profile <> 'ordinary' THEN 0 ELSE coalesce(earnings_quality * 10, 0) END + coalesce(stability * 10, 0)
 + coalesce(industry * 10, 0) + coalesce(macro * 15, 0) AS points FROM known),
raw AS (SELECT *, points / nullif(used, 0) AS score, CASE WHEN used / possible < 0.7 OR used = 0 OR 2001 - latest_year > 2 THEN 'unrated' WHEN points / used >= 70 THEN 'buy' WHEN points / used >= 45 THEN 'watch' ELSE 'avoid' END AS first FROM t),
rated AS (SELECT *, first = 'buy' AND (ni1 <= 0 OR se <= 0) AS stopped, CASE WHEN first = 'buy' AND (ni1 <= 0 OR se <= 0) THEN 'watch' ELSE first END AS level FROM raw)"""


def profiled(spark, sf_dir):
    return saved(C.fin_years(spark, sf_dir).withColumn("profile", F.expr(PROFILE)), "years")


def rated(spark, sf_dir):
    """Saved twice: every score stands in many expressions of what follows, which would repeat all that it is made of."""
    scores = scorecard.with_outside(saved(scorecard.groups(profiled(spark, sf_dir)), "groups"), by_industry(spark, sf_dir), by_macro(spark, sf_dir))
    return saved(scorecard.totals(saved(scores, "scores"), 2001), "rated")


@query(f"{YEARS}, {GROUPS} SELECT ticker, profile, latest_year, round(growth, 5) AS growth, round(profitability, 5) AS profitability, round(health, 5) AS health, round(earnings_quality, 5) AS earnings_quality, round(stability, 5) AS stability FROM grp")
def scorecard_groups(spark, sf_dir):
    rows = scorecard.groups(profiled(spark, sf_dir))
    return rows.select("ticker", "profile", "latest_year", *[F.round(c, 5).alias(c) for c in ("growth", "profitability", "health", "earnings_quality", "stability")])


@query(f"{YEARS}, {GROUPS} SELECT level, stopped, count(*) AS n FROM rated GROUP BY ALL")
def scorecard_levels(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("level", "stopped").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{YEARS}, {GROUPS}, fit AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, ticker) AS place FROM rated WHERE level <> 'unrated' AND rev1 >= 50000),
tall AS (UNPIVOT (SELECT ticker, growth, profitability, health, CASE WHEN profile = 'ordinary' THEN earnings_quality END AS earnings_quality, stability, industry, macro FROM fit) ON growth, profitability, health, earnings_quality, stability, industry, macro INTO NAME g VALUE v),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY v DESC, list_position(['growth', 'profitability', 'health', 'earnings_quality', 'stability', 'industry', 'macro'], g)) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM tall),
named AS (SELECT ticker, string_agg(g, ',' ORDER BY r) FILTER (r <= 2 AND v >= 60) AS strong, string_agg(g, ',' ORDER BY r) FILTER (r > n - 2 AND v < 45) AS weak FROM numbered GROUP BY ticker)
SELECT sector, place, ticker, level, round(score, 5) AS score, coalesce(strong, '') AS strong, coalesce(weak, '') AS weak FROM fit LEFT JOIN named USING (ticker) WHERE place <= 10""", "place")
def scorecard_sector_list(spark, sf_dir):
    rows = scorecard.sector_list(rated(spark, sf_dir), 10, 50_000)
    return rows.select("sector", "place", "ticker", "level", F.round("score", 5).alias("score"), F.array_join("strong", ",").alias("strong"), F.array_join("weak", ",").alias("weak"))


@query(f"""{YEARS}, {GROUPS} SELECT sector, count(*) AS companies, count(*) FILTER (level <> 'unrated' AND rev1 < 50000) AS small, count(*) FILTER (level = 'unrated') AS unrated,
count(*) FILTER (level = 'buy' AND rev1 >= 50000) AS buy, count(*) FILTER (level = 'watch' AND rev1 >= 50000) AS watch, count(*) FILTER (level = 'avoid' AND rev1 >= 50000) AS avoid FROM rated GROUP BY sector""")
def scorecard_sector_counts(spark, sf_dir):
    return scorecard.sector_counts(rated(spark, sf_dir), 50_000)


@query(f"{YEARS}, {INDUSTRY} SELECT sector, companies, outliers, round(growth, 6) AS growth, round(margin_change, 6) AS margin_change, round(score, 5) AS score FROM industry_scores")
def industry_signal(spark, sf_dir):
    return by_industry(spark, sf_dir).select("sector", "companies", "outliers", F.round("growth", 6).alias("growth"), F.round("margin_change", 6).alias("margin_change"), F.round("score", 5).alias("score"))


@query(f"WITH {MACRO} SELECT series_id, status, round(latest, 5) AS latest, round(base, 5) AS base, round(change, 5) AS change, round(signal, 6) AS signal FROM signals")
def macro_asof_change(spark, sf_dir):
    return macro(spark, sf_dir).select("series_id", "status", *[F.round(c, n).alias(c) for c, n in (("latest", 5), ("base", 5), ("change", 5), ("signal", 6))])


@query(f"WITH {MACRO} SELECT sector, round(score, 5) AS score, used, dropped FROM macro_scores")
def macro_sector_score(spark, sf_dir):
    return by_macro(spark, sf_dir).withColumn("score", F.round("score", 5))


@query("""WITH obs AS (SELECT o_custkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders), one AS (SELECT * FROM obs WHERE r = 1),
asked AS (SELECT c_custkey, TIMESTAMP '1997-06-30 00:00:00' AS t FROM customer)
SELECT c_custkey, o_totalprice, o_orderdate AS value_date FROM asked ASOF LEFT JOIN one ON c_custkey = o_custkey AND t >= o_orderdate""")
def asof_join(spark, sf_dir):
    orders = windows.latest(C.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], [F.col("o_orderkey")])
    asked = C.table(spark, sf_dir, "customer").select("c_custkey", F.lit("1997-06-30").cast("timestamp").alias("t"))
    seen = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice")
    return joins.asof(asked, seen, "c_custkey", "t", "o_orderdate", "o_totalprice").drop("t")


@query(f"""{YEARS}, ranked AS (SELECT ticker, net_income * 100.0 / nullif(revenue, 0) AS margin, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r FROM fin_years)
SELECT ticker, count(margin) AS n, round(CASE WHEN count(margin) >= 4 AND avg(margin) > 0 THEN stddev_pop(margin) / avg(margin) END, 6) AS cv FROM ranked WHERE r <= 5 GROUP BY ticker""")
def stability_cv(spark, sf_dir):
    rows = windows.latest(C.fin_years(spark, sf_dir), ["ticker"], [F.desc("fiscal_year")], 5).withColumn("margin", N.divide(F.col("net_income") * 100.0, F.col("revenue")))
    cv = F.when((F.count("margin") >= 4) & (F.avg("margin") > 0), N.divide(F.stddev_pop("margin"), F.avg("margin")))
    return rows.groupBy("ticker").agg(F.count("margin").alias("n"), F.round(cv, 6).alias("cv"))


# Graph


@query(f"{KNOW} SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM knowledge GROUP BY rel")
def node_edge_histogram(spark, sf_dir):
    return C.knowledge(spark, sf_dir).groupBy("rel").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def starts(spark, sf_dir):
    return C.companies(spark, sf_dir).select(F.col("suppkey").alias("node"))


def questions(spark, sf_dir):
    """Searches ask for every company whose number 20 divides, against all companies."""
    return starts(spark, sf_dir).where("node % 20 = 0")


def walk_sql(name: str, a: str, b: str) -> str:
    return f"""{name}_walk AS (
    SELECT suppkey AS start, [suppkey] AS path, []::DOUBLE[] AS percents, suppkey AS last, 0 AS depth FROM companies
    UNION ALL SELECT start, list_append(path, {b}), list_append(percents, percent), {b}, depth + 1 FROM {name}_walk JOIN ownership ON last = {a} WHERE depth < 3 AND NOT list_contains(path, {b})
), {name} AS (SELECT start, last AS "end", depth, path, list_reduce(list_prepend(1.0::DOUBLE, percents), lambda x, y: x * y) AS economic, list_min(percents) > 0.5 AS control, list_min(percents) AS weakest FROM {name}_walk WHERE depth > 0)"""


UP, DOWN = walk_sql("up", "company", "owner"), walk_sql("down", "owner", "company")
CHAINS = f"WITH RECURSIVE {C.OWNERSHIP_SQL}, "


def kept_sql(name: str) -> str:
    return f"""SELECT start, "end", depth, round(economic, 8) AS economic, control, round(weakest, 8) AS weakest, CASE WHEN economic < 0.005 THEN 'too_small' ELSE 'kept' END AS reason FROM {name}"""


def chain_rows(spark, sf_dir, direction):
    rows = graph.assembled(graph.chains(C.ownership(spark, sf_dir), starts(spark, sf_dir), 3, direction))
    return rows.select("start", "end", "depth", F.round("economic", 8).alias("economic"), "control", F.round("weakest", 8).alias("weakest"), "reason")


@query(f"{CHAINS}{UP} {kept_sql('up')}")
def ownership_upstream(spark, sf_dir):
    return chain_rows(spark, sf_dir, "up")


@query(f"{CHAINS}{DOWN} {kept_sql('down')}")
def ownership_downstream(spark, sf_dir):
    return chain_rows(spark, sf_dir, "down")


@query(f"""{CHAINS}{UP} SELECT start, "end", count(*) AS chains, round(sum(economic), 6) AS estimated, bool_or(control) AS controls FROM up WHERE economic >= 0.005 GROUP BY ALL""")
def ownership_between(spark, sf_dir):
    rows = graph.assembled(graph.chains(C.ownership(spark, sf_dir), starts(spark, sf_dir), 3)).where("reason = 'kept'")
    return rows.groupBy("start", "end").agg(F.count(F.lit(1)).alias("chains"), F.round(F.sum("economic"), 6).alias("estimated"), F.bool_or("control").alias("controls"))


@query(f"""{CHAINS}{UP}, placed AS (SELECT *, depth = 1 AS direct, row_number() OVER (PARTITION BY start, depth = 1 ORDER BY control DESC, round(economic, 9) DESC, "end", path) AS place FROM up WHERE economic >= 0.005)
SELECT start, direct, place, "end", CASE "end" % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'organisation' END AS kind, control, round(economic, 8) AS economic FROM placed WHERE place <= 5""", "place")
def ownership_ranked(spark, sf_dir):
    rows = graph.assembled(graph.chains(C.ownership(spark, sf_dir), starts(spark, sf_dir), 3)).withColumn("economic", F.round("economic", 9))
    label = F.when(F.col("end") % 3 == 0, "Company").when(F.col("end") % 3 == 1, "Person").otherwise("Organization")
    return graph.ranked(rows, 5).select("start", "direct", "place", "end", graph.owner_kind(label).alias("kind"), "control", F.round("economic", 8).alias("economic"))


@query(f"""{CHAINS}{UP}, {DOWN}, u AS (SELECT start, string_agg(DISTINCT CAST("end" AS VARCHAR), ',' ORDER BY CAST("end" AS VARCHAR)) FILTER (control AND economic >= 0.005) AS controllers, count(*) FILTER (economic >= 0.005) AS owners, count(*) FILTER (economic < 0.005) AS us FROM up GROUP BY start),
d AS (SELECT start, string_agg(DISTINCT CAST("end" AS VARCHAR), ',' ORDER BY CAST("end" AS VARCHAR)) FILTER (control AND economic >= 0.005) AS controlled, count(*) FILTER (economic >= 0.005) AS holdings, count(*) FILTER (economic < 0.005) AS ds FROM down GROUP BY start),
big AS (SELECT * FROM ownership WHERE percent >= 0.05), r AS (SELECT x.company AS start, count(DISTINCT y.company) AS related FROM big x JOIN big y USING (owner) WHERE x.company <> y.company GROUP BY x.company),
j AS (SELECT suppkey AS start, coalesce(controllers, '') AS controllers, coalesce(controlled, '') AS controlled, coalesce(owners, 0) AS owners, coalesce(holdings, 0) AS holdings, coalesce(related, 0) AS related, coalesce(us, 0) + coalesce(ds, 0) AS too_small
FROM companies LEFT JOIN u ON u.start = suppkey LEFT JOIN d ON d.start = suppkey LEFT JOIN r ON r.start = suppkey)
SELECT start, controllers, controlled, CASE WHEN controllers <> '' AND controlled <> '' THEN 'both' WHEN controllers <> '' THEN 'controlled' WHEN controlled <> '' THEN 'controls' ELSE 'none' END AS verdict, owners, holdings, related, too_small, CAST(0 AS BIGINT) AS unknown_stakes,
array_to_string(list_filter([CASE WHEN owners = 0 THEN 'no_owners' END, CASE WHEN holdings = 0 THEN 'no_holdings' END, CASE WHEN related = 0 THEN 'no_shared_owners' END], lambda x: x IS NOT NULL), ',') AS gaps FROM j""")
def ownership_network(spark, sf_dir):
    rows = graph.network(C.ownership(spark, sf_dir), starts(spark, sf_dir), 3)
    listed = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",")
    return rows.withColumn("controllers", listed("controllers")).withColumn("controlled", listed("controlled")).withColumn("gaps", F.array_join("gaps", ","))


@query(f"""{OWN} SELECT x.company AS "left", y.company AS "right", owner, x.percent AS left_percent, y.percent AS right_percent, x.percent >= 0.2 AND y.percent >= 0.2 AS both_large
FROM ownership x JOIN ownership y USING (owner) WHERE x.company % 20 = 0 AND x.company <> y.company""")
def common_holders(spark, sf_dir):
    return graph.common_holders(C.ownership(spark, sf_dir), questions(spark, sf_dir)).select("left", "right", "owner", "left_percent", "right_percent", "both_large")


@query(f"""{OWN}, big AS (SELECT * FROM ownership WHERE percent >= 0.05)
SELECT x.company AS node, y.company AS other, count(DISTINCT owner) AS n, string_agg(DISTINCT CAST(owner AS VARCHAR), ',' ORDER BY CAST(owner AS VARCHAR)) AS owners FROM big x JOIN big y USING (owner) WHERE x.company % 20 = 0 AND x.company <> y.company GROUP BY ALL""")
def co_invested(spark, sf_dir):
    rows = graph.co_invested(C.ownership(spark, sf_dir), questions(spark, sf_dir))
    return rows.select("node", "other", F.size("owners").cast("long").alias("n"), F.array_join(F.array_sort(F.col("owners").cast("array<string>")), ",").alias("owners"))


@query(f"{OWN} SELECT owner, count(DISTINCT company) AS companies, round(max(percent), 8) AS largest FROM ownership GROUP BY owner HAVING count(DISTINCT company) >= 2")
def bridging_owners(spark, sf_dir):
    return C.ownership(spark, sf_dir).groupBy("owner").agg(F.count_distinct("company").alias("companies"), F.round(F.max("percent"), 8).alias("largest")).where("companies >= 2")


@query(f"""{EDGES}, e AS (SELECT src, rel, dst, mentions, confidence, concat_ws(' ', src, rel, dst) AS evidence, src || '_10-K' AS doc_id, NULL::DOUBLE AS percent, NULL::VARCHAR AS as_of FROM knowledge
UNION ALL SELECT 'S' || company, 'OWNED_BY', 'S' || owner, 1, 1.0, NULL, NULL, percent, '2001-12-31' FROM ownership),
both_ways AS (SELECT src AS node, dst AS other, rel, 'out' AS direction, * EXCLUDE (src, rel, dst) FROM e UNION ALL SELECT dst, src, rel, 'in', * EXCLUDE (src, rel, dst) FROM e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY coalesce(confidence, 0) DESC, other, rel, direction) AS place FROM both_ways WHERE node IN (SELECT ticker FROM companies))
SELECT * FROM ranked WHERE place <= 12""", "place")
def neighbors_directed(spark, sf_dir):
    return graph.top_neighbors(told_edges(spark, sf_dir), every(spark, sf_dir).withColumnRenamed("ticker", "node"), tasks=C.edge_tasks(spark, sf_dir))


@query(f"""WITH RECURSIVE {C.OWNERSHIP_SQL}, both_ways AS (SELECT a, b, min(told) AS told FROM (SELECT company AS a, owner AS b, 'OWNED_BY stake ' || company AS told FROM ownership UNION SELECT owner, company, 'OWNED_BY stake ' || company FROM ownership) GROUP BY ALL),
walk AS (SELECT suppkey AS source, suppkey AS last, [suppkey] AS path, []::VARCHAR[] AS told FROM companies WHERE suppkey % 20 = 0
UNION ALL SELECT source, b, list_append(path, b), list_append(walk.told, both_ways.told) FROM walk JOIN both_ways ON last = a WHERE len(path) <= 3 AND NOT list_contains(path, b)),
best AS (SELECT *, row_number() OVER (PARTITION BY source, last ORDER BY len(path), path) AS r FROM walk WHERE len(path) > 1)
SELECT source, last AS target, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '-') AS path, array_to_string(told, ';') AS told FROM best WHERE r = 1""")
def shortest_path(spark, sf_dir):
    edges = C.ownership(spark, sf_dir).select(F.col("company").alias("src"), F.lit("OWNED_BY").alias("rel"), F.col("owner").alias("dst"), F.concat(F.lit("stake "), F.col("company").cast("string")).alias("evidence"))
    rows = graph.shortest_paths(edges, questions(spark, sf_dir).select(F.col("node").alias("source")), 3)
    told = F.zip_with("rels", "evidence", lambda r, e: F.concat_ws(" ", r, e))
    return rows.select("source", "target", "hops", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.array_join(told, ";").alias("told"))


@query(f"{ALL_EDGES} SELECT * FROM degrees")
def degree_classes(spark, sf_dir):
    return graph.degrees(all_edges(spark, sf_dir, C.fin_years(spark, sf_dir)))


@query(f"""{KNOW}, RECURSIVE_MERGES merges AS (SELECT ticker AS loser, 'S' || (suppkey - 1) AS survivor FROM companies WHERE suppkey % 5 > 1),
way AS (SELECT loser, survivor, 1 AS hops FROM merges UNION ALL SELECT w.loser, m.survivor, hops + 1 FROM way w JOIN merges m ON m.loser = w.survivor), survivors AS (SELECT loser, max_by(survivor, hops) AS survivor FROM way GROUP BY loser),
moved AS (SELECT coalesce(a.survivor, src) AS src, rel, coalesce(b.survivor, dst) AS dst, mentions, confidence FROM knowledge LEFT JOIN survivors a ON src = a.loser LEFT JOIN survivors b ON dst = b.loser)
SELECT src, rel, dst, CAST(sum(mentions) AS BIGINT) AS mentions, max(confidence) AS confidence FROM moved WHERE src <> dst GROUP BY ALL""".replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MERGES ", ""))
def entity_merge(spark, sf_dir):
    """Chains of three merges, which lead to one company."""
    wanted = C.companies(spark, sf_dir).where("suppkey % 5 > 1").select(F.col("ticker").alias("loser"), F.concat(F.lit("S"), (F.col("suppkey") - 1).cast("string")).alias("survivor"))
    return merges.merged(C.knowledge(spark, sf_dir), wanted, C.edge_tasks(spark, sf_dir))


# Names


KEYED = """WITH RECURSIVE keys AS (SELECT DISTINCT name, regexp_replace(regexp_replace(lower(name), '\\b(inc)\\b\\.?', '', 'g'), '[^a-z0-9]', '', 'g') AS k FROM (SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Inc.' ELSE '' END AS name FROM part)),
d AS (SELECT DISTINCT k FROM keys), fold AS (SELECT a.k AS short, min(b.k) AS long FROM d a JOIN d b ON length(a.k) >= 12 AND length(b.k) > length(a.k) AND length(b.k) - length(a.k) <= 5 AND starts_with(b.k, a.k) GROUP BY a.k),
way AS (SELECT short, long FROM fold UNION ALL SELECT w.short, f.long FROM way w JOIN fold f ON f.short = w.long), ends AS (SELECT short, max_by(long, length(long)) AS long FROM way GROUP BY short),
named AS (SELECT name, coalesce(long, k) AS group_key FROM keys LEFT JOIN ends ON k = short WHERE k <> ''), shown AS (SELECT group_key, list_sort(list(name)) AS members, min_by(name, {'a': CASE WHEN upper(name) = name THEN 1 ELSE 0 END, 'b': -length(name), 'c': name}) AS display FROM named GROUP BY group_key)"""


def part_names(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" Inc.")).otherwise(F.lit(""))).alias("name"))


@query(f"{KEYED} SELECT group_key, array_to_string(members, '|') AS members, display FROM shown")
def name_key_groups(spark, sf_dir):
    return resolve.key_groups(part_names(spark, sf_dir)).withColumn("members", F.array_join("members", "|"))


@query(f"{KEYED} SELECT name, display AS canonical FROM (SELECT unnest(members) AS name, display FROM shown)")
def canonical_names(spark, sf_dir):
    return resolve.displayed(part_names(spark, sf_dir))


@query(f"{KEYED} SELECT group_key, display, CAST(len(members) AS INTEGER) AS n FROM shown WHERE len(members) >= 2")
def merge_review(spark, sf_dir):
    return resolve.review(part_names(spark, sf_dir)).select("group_key", "display", "n")


def asked(spark, sf_dir):
    names = C.companies(spark, sf_dir)
    return names.select(F.when(F.col("suppkey") % 3 == 0, F.lower("name")).when(F.col("suppkey") % 3 == 1, F.col("ticker")).otherwise(F.concat("name", F.lit(" Ltd"))).alias("query"))


@query("""WITH q AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN 'S' || s_suppkey ELSE s_name || ' Ltd' END AS query, 'S' || s_suppkey AS ticker, s_suppkey % 3 AS k FROM supplier)
SELECT query, 'ok' AS status, ticker, CASE k WHEN 1 THEN 'ticker' ELSE 'exact' END AS match FROM q""")
def resolve_names(spark, sf_dir):
    return resolve.resolve(asked(spark, sf_dir), C.companies(spark, sf_dir).drop("market")).select("query", "status", "ticker", "match")


@query("""WITH c AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS ticker, s_name AS name, s_suppkey % 2 = 1 AS us FROM supplier),
twins AS (SELECT 'Twin ' || (k // 2) AS query, min_by(ticker, {'a': length(ticker), 'b': ticker}) AS ticker FROM c GROUP BY k // 2)
SELECT 'AKA ' || k AS query, 'ok' AS status, ticker, 'exact' AS match, 1 AS n FROM c UNION ALL SELECT query, 'ok', ticker, 'exact', 1 FROM twins
UNION ALL SELECT name || ' Joint Stock', 'ok', ticker, 'core', 1 FROM c
UNION ALL SELECT ticker || '.US', CASE WHEN us THEN 'ok' ELSE 'not_found' END, CASE WHEN us THEN ticker END, CASE WHEN us THEN 'ticker' END, CASE WHEN us THEN 1 ELSE 0 END FROM c""", "n")
def resolve_tiers(spark, sf_dir):
    """Names by which the weaker rules decide: an alias, an alias that two companies of one CIK share, a core, and a ticker asked for in one market."""
    key = F.col("suppkey")
    text = lambda c: c.cast("string")
    pair = F.floor(key / 2)
    companies = C.companies(spark, sf_dir).select(
        key, "ticker", "name", F.array(F.concat(F.lit("aka "), text(key)), F.concat(F.lit("twin "), text(pair))).alias("aliases"), F.when(key % 2 == 1, "US").otherwise("VN").alias("market"), pair.alias("cik")
    )
    forms = F.array(F.concat(F.lit("AKA "), text(key)), F.concat(F.lit("Twin "), text(pair)), F.concat("name", F.lit(" Joint Stock")), F.concat("ticker", F.lit(".US")))
    rows = resolve.resolve(companies.select(F.explode(forms).alias("query")), companies)
    return rows.select("query", "status", "ticker", "match", F.col("n_candidates").cast("int").alias("n"))


@query("""SELECT 'S' || s_suppkey || ' (' || s_name || ')' AS query, 'ok' AS status, 'S' || s_suppkey AS ticker FROM supplier""")
def resolve_forms(spark, sf_dir):
    names = C.companies(spark, sf_dir).drop("market")
    return resolve.resolve_forms(names.select(F.format_string("%s (%s)", "ticker", "name").alias("query")), names)


@query()
def fuzzy_suggest(spark, sf_dir):
    names = C.companies(spark, sf_dir)
    return resolve.suggestions(names.where("suppkey % 20 = 0").select(F.translate("name", "u", "v").alias("query")), names)


@query("""WITH nodes AS (SELECT s_name AS name, 'Company' AS label FROM supplier UNION ALL SELECT p_brand, 'Product' FROM part GROUP BY 1), q AS (SELECT * FROM (VALUES ('brand#1'), ('supplier#000000001'), ('brand#12'), ('00001')) t(query)),
m AS (SELECT query, name, label, CASE WHEN lower(name) = query THEN 0 WHEN starts_with(lower(name), query) AND regexp_matches(lower(name), '(^|[^a-z0-9])' || query || '([^a-z0-9]|$)') THEN 1
WHEN regexp_matches(lower(name), '(^|[^a-z0-9])' || query || '([^a-z0-9]|$)') THEN 2 WHEN contains(lower(name), query) THEN 3 END AS tier FROM nodes, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, label <> 'Company', length(name), name) AS place FROM m WHERE tier IS NOT NULL) SELECT query, name, label, tier, tier = 3 AS weak, place FROM r WHERE place <= 5""", "place")
def find_entity_ranked(spark, sf_dir):
    nodes = C.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("Company").alias("label")).union(C.table(spark, sf_dir, "part").select("p_brand", F.lit("Product")).distinct())
    return resolve.find_ranked(nodes, spark.createDataFrame([("brand#1",), ("supplier#000000001",), ("brand#12",), ("00001",)], "query string"))


@query(r"""SELECT DISTINCT doc_id, word, replace(strip_accents(lower(word)), 'đ', 'd') AS folded FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> ''""")
def accent_insensitive_match(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where("word <> ''")
    plain = docs.select("doc_id", "word", X.fold(F.col("word")).alias("folded"))
    return plain.where(F.collate("word", "UNICODE_CI_AI") == F.collate("folded", "UNICODE_CI_AI"))


# Text


@query()
def html_to_text(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").select("page_id", documents.html_to_text("html").alias("text"))


@query()
def split_sections(spark, sf_dir):
    return documents.sections(C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


@query()
def chunk_documents(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("0").alias("item"), "text")
    return documents.chunks(docs, 1200, 200)


@query()
def report_chunks(spark, sf_dir):
    return documents.report_chunks(C.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text"))


@query(r"""SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text, ' ')) >= 200 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0) < 0.15""")
def prose_filter(spark, sf_dir):
    return documents.prose_pages(C.table(spark, sf_dir, "documents")).select("doc_id", F.length(F.trim("text")).cast("long").alias("n"))


@query(r"""WITH y AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1)) AS y FROM documents), n AS (SELECT doc_id, y, count(*) AS n FROM y GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) AS r FROM n), t AS (SELECT doc_id, max(y) FILTER (r = 1) AS y, max(n) FILTER (r = 1) AS a, max(n) FILTER (r = 2) AS b FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN a >= 2 * coalesce(b, 0) THEN CAST(y AS INTEGER) END AS year FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN t USING (doc_id)""")
def report_year_mode(spark, sf_dir):
    return documents.printed_year(C.table(spark, sf_dir, "documents"))


@query()
def chunk_score_select(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), F.lit("1A").alias("item"), "text")
    orgs = spark.createDataFrame([("reing",), ("license",), ("public",), ("erthen",)], "org string")
    return documents.selected(documents.scored(docs, orgs, spark.createDataFrame([("src0", "license")], "doc_id string, org string")))


COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def asked_vectors(spark, sf_dir):
    return C.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 10""", "place")
def vector_topk(spark, sf_dir):
    return vector.top_k(C.table(spark, sf_dir, "embeddings"), asked_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label IN (1, 4)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 10""", "place")
def vector_topk_filtered(spark, sf_dir):
    rows = C.table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 4))
    return vector.top_k(rows, asked_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
t AS (SELECT *, CASE WHEN label = query_id % 10 AND vec_id % 97 = query_id % 97 THEN 0 WHEN label = query_id % 10 AND vec_id % 2 = 0 THEN 1 WHEN label IN (0, 1, 2) THEN 2 END AS tier FROM s),
b AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM t WHERE tier IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM b WHERE tier = best)
SELECT query_id, vec_id, round(score, 6) AS score, place, ['none', 'years', 'years and items'][tier + 1] AS relaxed FROM r WHERE place <= 6""", "place")
def search_relaxation(spark, sf_dir):
    year, item = (F.col("vec_id") % 97, F.col("query_id") % 97), (F.col("label").cast("long"), F.col("query_id") % 10)
    tiers = [(F.lit(True), (item, year)), (F.col("vec_id") % 2 == 0, (item,)), (F.col("label").isin(0, 1, 2), ())]
    rows = vector.relaxed(C.table(spark, sf_dir, "embeddings"), asked_vectors(spark, sf_dir), tiers, 6)
    return rows.select("query_id", "vec_id", F.round("score", 6).alias("score"), "place", "relaxed")


@query("""SELECT doc_id, regexp_matches(text, '(?i)ignore (all |any |the )?(previous|prior|above) (instructions?|prompts?)|disregard (all |any |the )?(previous|prior|above)|you are now|new instructions?:|system prompt|reveal (your )?(system )?prompt') AS flagged FROM documents""")
def injection_flags(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", X.reads_like_instruction(F.col("text")).alias("flagged"))


@query(f"{YEARS} SELECT ticker, max(fiscal_year) AS latest, 2002 - max(fiscal_year) >= 2 AS stale FROM fin_years GROUP BY ticker")
def staleness_flags(spark, sf_dir):
    return C.fin_years(spark, sf_dir).groupBy("ticker").agg(F.max("fiscal_year").alias("latest")).withColumn("stale", F.lit(2002) - F.col("latest") >= 2)


@query()
def numbers_extract(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(numbers_in("text")).alias("n")).select("doc_id", "n.token", "n.at", "n.value", "n.negative", "n.percent")


# Knowledge and stored tables


def raw_triples(spark, sf_dir):
    own = C.ownership(spark, sf_dir)
    kind = F.when(F.col("company") % 4 == 0, "Company").when(F.col("company") % 4 == 1, "Product").otherwise("Company")
    return own.select(
        F.col("company").cast("string").alias("chunk_id"), F.concat(F.lit("Firm "), F.col("company").cast("string")).alias("source"), F.lit("Company").alias("source_type"),
        F.when(F.col("company") % 3 == 0, "rival of").otherwise("supplied-by").alias("relation"),
        F.when(F.col("owner") % 5 == 0, F.lit("customers")).otherwise(F.concat(F.lit("Firm "), F.col("owner").cast("string"))).alias("target"), kind.alias("target_type"),
        F.when(F.col("company") % 2 == 0, "We  buy from\nothers").otherwise("no such words").alias("evidence"), (F.col("percent") * 2).alias("confidence"),
    )


TRIPLES = f"""{OWN}, valid AS (SELECT CAST(company AS VARCHAR) AS chunk_id, 'Firm ' || company AS source, CASE WHEN company % 3 = 0 THEN 'COMPETES_WITH' ELSE 'SUPPLIED_BY' END AS relation,
CASE WHEN owner % 5 = 0 THEN 'customers' ELSE 'Firm ' || owner END AS target, least(1.0, percent * 2) AS confidence, percent * 2 AS c, company, owner FROM ownership),
reasons AS (SELECT *, CASE WHEN target = 'customers' THEN 'stop_entity' WHEN company % 4 = 1 THEN 'off_ontology' WHEN company % 2 = 1 THEN 'no_evidence' END AS reject_reason FROM valid)"""


@query(f"{TRIPLES} SELECT coalesce(reject_reason, 'good') AS reason, count(*) AS n, round(sum(confidence), 6) AS confidence FROM reasons GROUP BY ALL")
def triple_validation(spark, sf_dir):
    raw = raw_triples(spark, sf_dir)
    chunks = raw.select("chunk_id", F.lit("In short: we buy from others every year.").alias("text")).distinct()
    rows = triples.validated(raw, chunks)
    return rows.groupBy(F.coalesce("reject_reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"""{TRIPLES}, renamed AS (SELECT CASE WHEN company % 6 = 0 THEN 'Firm X' ELSE source END AS source, CASE WHEN owner % 6 = 0 AND owner % 5 <> 0 THEN 'Firm X' ELSE target END AS target FROM reasons)
SELECT CASE WHEN target = 'customers' THEN 'noise' WHEN source = target THEN 'self_loop' ELSE 'kept' END AS curation, count(*) AS n FROM renamed GROUP BY ALL""")
def triple_curation(spark, sf_dir):
    raw = raw_triples(spark, sf_dir)
    aliases = C.companies(spark, sf_dir).where("suppkey % 6 = 0").select(F.concat(F.lit("Firm "), F.col("suppkey").cast("string")).alias("name"), F.lit("Firm X").alias("into"))
    return triples.curated(raw, aliases, spark.createDataFrame([("customers",)], "name string")).groupBy("curation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT cik, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'S' || k END AS ticker, CASE WHEN k % 2 = 0 THEN name ELSE name || ' new' END AS name, CASE WHEN k % 3 = 0 THEN 'NYSE' ELSE 'Nasdaq' END AS exchange, CASE WHEN k % 2 = 0 THEN 'text' ELSE 'metrics' END AS tier
FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_suppkey AS k, s_name AS name FROM supplier) WHERE k % 2 = 0 OR k % 3 = 0""")
def upsert_companies(spark, sf_dir):
    base = C.companies(spark, sf_dir).select(F.lpad(F.col("suppkey").cast("string"), 10, "0").alias("cik"), "ticker", "name", "suppkey")
    old = base.where("suppkey % 2 = 0").select("ticker", "cik", "name", F.lit("Nasdaq").alias("exchange"), F.lit("text").alias("tier"))
    new = base.where("suppkey % 3 = 0").select("ticker", "cik", F.concat("name", F.lit(" new")).alias("name"), F.lit("NYSE").alias("exchange"))
    return upserts.upsert_listed(old, new)


@query(f"""{KNOW} SELECT src, rel, dst, CAST(mentions + CASE WHEN mentions > 1 THEN 1 ELSE 0 END AS BIGINT) AS mentions, CASE WHEN mentions > 1 THEN 0.5 ELSE confidence END AS confidence, CASE WHEN mentions > 1 THEN 'new' ELSE 'old' END AS evidence FROM knowledge""")
def upsert_edges(spark, sf_dir):
    old = C.knowledge(spark, sf_dir).withColumn("evidence", F.lit("old"))
    new = old.where("mentions > 1").select("src", "rel", "dst", F.lit(1).cast("long").alias("mentions"), F.lit(0.5).alias("confidence"), F.lit("new").alias("evidence"), F.lit(1).alias("load_order"))
    return upserts.upsert_edges(old, new, C.edge_tasks(spark, sf_dir))


TIERED = "CASE s_suppkey % 3 WHEN 0 THEN 'metrics' WHEN 1 THEN 'text' ELSE 'graph' END"


@query(f"SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'text' ELSE {TIERED} END AS tier FROM supplier")
def tier_monotone(spark, sf_dir):
    rows = C.companies(spark, sf_dir).select("ticker", "suppkey", F.when(F.col("suppkey") % 3 == 0, "metrics").when(F.col("suppkey") % 3 == 1, "text").otherwise("graph").alias("tier"))
    return upserts.raise_tiers(rows.drop("suppkey"), rows.where("suppkey % 2 = 0").select("ticker", F.lit("text").alias("tier")))


@query(f"""WITH t AS (SELECT s_suppkey AS k, {TIERED} AS tier, s_suppkey % 4 = 0 AS nocik, s_suppkey % 2 = 0 AS has FROM supplier)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN nocik AND tier <> 'metrics' THEN 'corrected' WHEN has AND tier <> 'graph' AND NOT nocik THEN 'raised' WHEN NOT has AND tier = 'graph' THEN 'stale' ELSE 'same' END AS change FROM t) GROUP BY ALL""")
def tier_sync(spark, sf_dir):
    k = F.col("suppkey")
    rows = C.companies(spark, sf_dir).select("ticker", "suppkey", F.when(k % 4 != 0, k.cast("string")).alias("cik"), F.when(k % 3 == 0, "metrics").when(k % 3 == 1, "text").otherwise("graph").alias("tier"))
    edges = rows.where("suppkey % 2 = 0").select(F.col("ticker").alias("src"))
    return upserts.sync_tiers(rows.drop("suppkey"), edges).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# Change detection

SNAPSHOTS = """old AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01' GROUP BY ALL),
new AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '2000-06-01' GROUP BY ALL)"""


def snapshots(spark, sf_dir):
    lines = C.table(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("value")
    make = lambda rows: rows.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fiscal_year")).agg(total).withColumn("metric", F.lit("revenue"))
    return make(lines.where(F.col("l_shipdate") < F.lit("1999-06-01").cast("timestamp"))), make(lines.where((F.col("l_shipdate") >= F.lit("1996-03-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2000-06-01").cast("timestamp"))))


@query(f"""WITH {SNAPSHOTS}, d AS (SELECT coalesce(o.l_suppkey, n.l_suppkey) AS ticker, coalesce(o.fiscal_year, n.fiscal_year) AS fiscal_year, o.value AS old, n.value AS new FROM old o FULL JOIN new n ON o.l_suppkey = n.l_suppkey AND o.fiscal_year = n.fiscal_year),
k AS (SELECT *, CASE WHEN old IS NULL THEN 'new_year' WHEN new IS NULL THEN 'gone' WHEN old <> 0 AND abs(new - old) / abs(old) > 0.001 THEN 'restated' END AS kind FROM d WHERE ticker IN (SELECT l_suppkey FROM old))
SELECT ticker, fiscal_year, 'revenue' AS metric, kind, CASE WHEN kind = 'gone' THEN 'medium' ELSE 'high' END AS severity, old, new FROM k WHERE kind IS NOT NULL""")
def watch_diff_metrics(spark, sf_dir):
    return watch.metric_changes(*snapshots(spark, sf_dir))


@query(f"""{OWN}, old AS (SELECT * FROM ownership WHERE owner % 4 <> 0), new AS (SELECT company, owner, percent + CASE owner % 3 WHEN 0 THEN 0.06 WHEN 1 THEN 0.01 ELSE 0 END AS percent FROM ownership WHERE owner % 5 <> 0),
d AS (SELECT coalesce(o.company, n.company) AS ticker, coalesce(o.owner, n.owner) AS owner, o.percent AS old, n.percent AS new FROM old o FULL JOIN new n ON o.company = n.company AND o.owner = n.owner),
k AS (SELECT *, CASE WHEN old IS NULL THEN 'new_holder' WHEN new IS NULL THEN 'gone_holder' WHEN abs(new - old) >= 0.005 THEN 'changed' END AS kind FROM d WHERE ticker IN (SELECT company FROM old))
SELECT ticker, owner, kind, CASE WHEN (old IS NULL AND new >= 0.05) OR abs(new - old) >= 0.05 THEN 'high' ELSE 'medium' END AS severity, round(old, 8) AS old, round(new, 8) AS new FROM k WHERE kind IS NOT NULL""")
def watch_diff_holders(spark, sf_dir):
    own = C.ownership(spark, sf_dir).withColumnRenamed("company", "ticker")
    add = F.when(F.col("owner") % 3 == 0, 0.06).when(F.col("owner") % 3 == 1, 0.01).otherwise(0.0)
    rows = watch.holder_changes(own.where("owner % 4 <> 0"), own.where("owner % 5 <> 0").withColumn("percent", F.col("percent") + add))
    return rows.withColumn("old", F.round("old", 8)).withColumn("new", F.round("new", 8))


@query(f"""WITH {SNAPSHOTS}, n AS (SELECT o.l_suppkey FROM old o FULL JOIN new n ON o.l_suppkey = n.l_suppkey AND o.fiscal_year = n.fiscal_year WHERE o.value IS NULL OR n.value IS NULL OR (o.value <> 0 AND abs(n.value - o.value) / abs(o.value) > 0.001))
SELECT s_suppkey AS ticker, CASE WHEN s_suppkey NOT IN (SELECT l_suppkey FROM old) THEN 'baseline' WHEN EXISTS (SELECT 1 FROM n WHERE n.l_suppkey = s_suppkey) THEN 'changed' ELSE 'ok' END AS status FROM supplier""")
def watch_statuses(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    watched = C.companies(spark, sf_dir).select(F.col("suppkey").alias("ticker"))
    return watch.statuses(watched, old, watch.metric_changes(old, new)).select("ticker", "status")


@query(f"""{YEARS}, {OWNERSHIP_ONLY}, f AS (SELECT ticker, max(fiscal_year) AS latest_year, string_agg(fiscal_year || ':' || CAST(floor(revenue) AS BIGINT) || ':' || CAST(floor(net_income) AS BIGINT), ',' ORDER BY fiscal_year) AS figures
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS r FROM fin_years WHERE fiscal_year BETWEEN 1990 AND 2100) WHERE r <= 6 GROUP BY ticker),
h AS (SELECT 'S' || company AS ticker, string_agg(owner || ':' || CAST(round(percent * 1000000) AS BIGINT), ',' ORDER BY owner) AS holders FROM ownership GROUP BY company)
SELECT ticker, latest_year, figures, holders FROM f FULL JOIN h USING (ticker)""")
def watch_fingerprint(spark, sf_dir):
    stakes = C.ownership(spark, sf_dir).select(F.concat(F.lit("S"), F.col("company").cast("string")).alias("ticker"), "owner", "percent")
    rows = watch.fingerprint(C.fin_years(spark, sf_dir), stakes)
    whole = lambda c: F.floor(c).cast("string")
    year = lambda e: F.concat_ws(":", e["key"].cast("string"), whole(e["value"]["revenue"]), whole(e["value"]["net_income"]))
    stake = lambda e: F.concat_ws(":", e["key"].cast("string"), F.round(e["value"] * 1_000_000).cast("long").cast("string"))
    told = lambda name, f: F.array_join(F.transform(F.map_entries(name), f), ",").alias(name)
    return rows.select("ticker", "latest_year", told("figures", year), told("holders", stake))


@query(f"""{OWN} SELECT 'companies' AS name, count(*) AS n FROM companies UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'ownership', count(*) FROM ownership""")
def freshness_snapshot(spark, sf_dir):
    t = lambda n: C.table(spark, sf_dir, n)
    return watch.snapshot({"companies": C.companies(spark, sf_dir), "documents": t("documents"), "embeddings": t("embeddings"), "ownership": C.ownership(spark, sf_dir)})


@query(f"""{YEARS}, odd AS (SELECT ticker, CASE WHEN suppkey % 11 = 0 THEN 35000 ELSE fiscal_year END AS fiscal_year, CASE WHEN suppkey % 13 <> 0 THEN currency END AS currency, suppkey FROM fin_years), known AS (SELECT ticker FROM companies WHERE suppkey % 9 <> 0)
SELECT 'implausible_year' AS name, count(*) AS n FROM odd WHERE NOT fiscal_year BETWEEN 1990 AND 2100 UNION ALL SELECT 'no_currency', count(*) FROM odd WHERE currency IS NULL
UNION ALL SELECT 'orphan_figures', count(*) FROM odd ANTI JOIN known USING (ticker) UNION ALL SELECT 'no_figures', count(*) FROM known ANTI JOIN odd USING (ticker)""")
def anomalies(spark, sf_dir):
    odd = C.fin_years(spark, sf_dir).withColumn("fiscal_year", F.when(F.col("suppkey") % 11 == 0, 35000).otherwise(F.col("fiscal_year"))).withColumn("currency", F.when(F.col("suppkey") % 13 != 0, F.col("currency")))
    return watch.anomalies(odd, C.companies(spark, sf_dir).where("suppkey % 9 <> 0"))


# Logs, sessions, events


@query("""SELECT event_type, count(*) FILTER (value >= 50) AS ok, count(*) FILTER (value < 50) AS error, count(*) FILTER (value IS NULL) AS unknown, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type""")
def tool_status_pivot(spark, sf_dir):
    return sessions.tool_status(C.table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query("""SELECT user_id, bool_and(value > 0) AS every_positive, bool_or(value > 90) AS some_large FROM events GROUP BY user_id""")
def tool_all_any(spark, sf_dir):
    return sessions.all_any(C.table(spark, sf_dir, "events"))


@query("""SELECT event_type AS category, count(*) AS n, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(value / 100), 6) AS recall, round(avg(value), 6) AS seconds FROM events GROUP BY ROLLUP (event_type)""")
def eval_rollup(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") >= 50).alias("correct"), (F.col("value") / 100).alias("recall"), F.col("value").alias("seconds"))
    return verify.rollup(rows).withColumns({c: F.round(c, 6) for c in ("accuracy", "recall", "seconds")})


@query("""SELECT conv_id, count(*) AS messages, min_by(substr(text, 1, 60), turn) FILTER (role = 'user') AS title, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def session_summary(spark, sf_dir):
    return sessions.summaries(C.table(spark, sf_dir, "conversations"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text) AS r FROM conversations) SELECT conv_id, turn, role, substr(text, 1, 700) AS text FROM r WHERE r <= 3""")
def last_turns(spark, sf_dir):
    return sessions.last_turns(C.table(spark, sf_dir, "conversations"), 3)


@query("SELECT conv_id, string_agg(turn || ' ' || role || ': ' || text, chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def session_nested(spark, sf_dir):
    rows = sessions.nested(C.table(spark, sf_dir, "conversations"))
    said = F.transform("messages", lambda m: F.concat(m["turn"].cast("string"), F.lit(" "), m["role"], F.lit(": "), m["text"]))
    return rows.select("conv_id", F.array_join(said, "\n").alias("messages"))


@query("""WITH w AS (SELECT *, (SELECT max(ts) FROM events) AS now FROM events), r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM w WHERE ts > now - INTERVAL 2 DAY) SELECT user_id, event_id, ts, place FROM r WHERE place <= 3""", "place")
def recent_alerts(spark, sf_dir):
    events = C.table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at")).crossJoin(F.broadcast(now))  # one row
    return watch.recent_alerts(rows, F.col("now"), 2, 3).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("at").alias("ts"), "place")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def events_tumbling(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n FROM events, range(0, 4) t(k) GROUP BY ALL""")
def events_sliding(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# Grading


@query("""WITH n AS (SELECT max(item_id) + 1 AS n FROM benchmark), wanted AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 5))) AS entity FROM benchmark),
j AS (SELECT d.doc_id AS answer_id, entity, coalesce(contains(upper(d.text), upper(entity)), false) AS hit FROM documents d JOIN wanted ON item_id = d.doc_id % (SELECT n FROM n))
SELECT answer_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall, max(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS any_form FROM j GROUP BY answer_id""")
def grade_entities(spark, sf_dir):
    """Each document is asked for the longer words of one benchmark item; all items are asked for in turn."""
    items = C.table(spark, sf_dir, "benchmark")
    wanted = items.select("item_id", F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 5))).alias("entity"))
    answers = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    n = items.agg((F.max("item_id") + 1).alias("n"))
    asked = answers.select("answer_id").crossJoin(F.broadcast(n)).select("answer_id", (F.col("answer_id") % F.col("n")).alias("item_id"))  # one row on the right
    return verify.grade_entities(answers, asked.join(wanted, "item_id").select("answer_id", "entity")).withColumn("recall", F.round("recall", 6))


@query(f"""{YEARS}, said AS (SELECT ticker || '-' || fiscal_year AS answer_id, revenue AS e, printf('%.2f', revenue / 1e6 * CASE WHEN fiscal_year % 4 = 0 THEN 1.5 ELSE 1.0 END) AS t FROM fin_years),
v AS (SELECT answer_id, least(abs(CAST(t AS DOUBLE) * 1e6 - e), abs(CAST(replace(t, '.', '') AS DOUBLE) * 1e6 - e)) / abs(e) AS error FROM said) SELECT answer_id, round(error, 9) AS error, error <= 0.01 AS correct FROM v""")
def grade_numeric(spark, sf_dir):
    answers = C.fin_years(spark, sf_dir).select(F.concat_ws("-", "ticker", "fiscal_year").alias("answer_id"), "fiscal_year", "revenue")
    said = answers.select("answer_id", F.format_string("Revenue was %.2f million USD.", F.col("revenue") / 1e6 * F.when(F.col("fiscal_year") % 4 == 0, 1.5).otherwise(1.0)).alias("text"))
    return verify.grade_numeric(said, answers.select("answer_id", F.col("revenue").alias("expected"))).withColumn("error", F.round("error", 9))


@query(f"""{YEARS}, said AS (SELECT ticker || '-' || fiscal_year AS answer_id, abs(revenue) AS v, printf('%.0f', revenue) AS t FROM fin_years)
SELECT answer_id, t AS token, CAST(12 AS INTEGER) AS "at", NULL::VARCHAR AS reason FROM said WHERE v >= 100
UNION ALL SELECT answer_id, '123,456,789', CAST(12 + length(t) + 18 AS INTEGER), CASE WHEN abs(v - 123456789) <= 0.01 * v OR abs(v - 123456.789::DOUBLE) <= 0.01 * v THEN 'sign_mismatch' ELSE 'not_in_source' END FROM said""")
def check_numbers(spark, sf_dir):
    years = C.fin_years(spark, sf_dir).select(F.concat_ws("-", "ticker", "fiscal_year").alias("answer_id"), "revenue", "net_income")
    # %.0f of Java rounds halves up, that of SQL to the even number
    said = years.select("answer_id", F.format_string("Revenue was %.0f USD and the loss 123,456,789 USD.", F.bround("revenue")).alias("text"))
    return verify.check_numbers(said, verify.value_sources(years.select("answer_id", F.col("revenue").alias("value"))))


@query(f"""{YEARS}, rows AS (SELECT ticker AS answer_id, unnest([revenue, net_income, CAST(fiscal_year AS DOUBLE)]) AS v FROM fin_years UNION ALL SELECT ticker, 2500000.0 FROM fin_years)
SELECT answer_id, count(*) AS numbers, count(*) FILTER (v <> 2500000.0 AND v < 0) AS losses, (SELECT count(*) FROM fin_years y WHERE y.ticker = answer_id) AS of_texts FROM rows GROUP BY answer_id""")
def nested_sources(spark, sf_dir):
    """What a tool returned for each company, as JSON of three levels: figures with their sign, and one sentence a year."""
    year = F.struct("fiscal_year", F.struct("revenue", "net_income").alias("figures"), F.lit("sold for 2.5 million").alias("note"), F.lit(True).alias("ok"))
    data = C.fin_years(spark, sf_dir).groupBy("ticker").agg(F.collect_list(year).alias("years"))
    rows = verify.nested_sources(data.select(F.col("ticker").alias("answer_id"), F.parse_json(F.to_json(F.struct("years"))).alias("data")))
    # "2.5" has two readings, 2.5 and 25 millions
    rows = rows.where("sign <> 0 or magnitude = 2500000")
    return rows.groupBy("answer_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("sign") < 0).alias("losses"), F.count_if(F.col("sign") == 0).alias("of_texts"))


@query(f"""{YEARS} SELECT 'lookup-' || ticker || '-' || fiscal_year AS qid, 'lookup' AS category, 'What was the revenue of ' || name || ' in fiscal year ' || fiscal_year || '?' AS question, revenue AS expected
FROM fin_years ORDER BY md5('7|' || ticker || '|' || fiscal_year) LIMIT 30""")
def test_questions(spark, sf_dir):
    return verify.questions(C.fin_years(spark, sf_dir), "revenue", 30)


# Set operations and the rest of Spark's grouping surface


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return C.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(C.table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(spark, sf_dir):
    lines = C.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return lines.where("l_returnflag = 'A'").select("k").intersect(lines.where("l_returnflag = 'R'").select("k"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(C.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query(f"""{YEARS} SELECT sector, currency, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, grouping(sector) * 2 + grouping(currency) AS level FROM fin_years GROUP BY CUBE (sector, currency)""")
def cube_revenue(spark, sf_dir):
    rows = C.fin_years(spark, sf_dir).cube("sector", "currency").agg(F.sum(F.col("revenue").cast("decimal(18,4)")).cast("double").alias("revenue"), F.grouping_id().alias("level"))
    return rows


@query(f"""{YEARS} SELECT sector, fiscal_year, count(*) AS n FROM fin_years GROUP BY GROUPING SETS ((sector), (fiscal_year), ())""")
def grouping_sets(spark, sf_dir):
    return C.fin_years(spark, sf_dir).groupingSets([[F.col("sector")], [F.col("fiscal_year")], []], F.col("sector"), F.col("fiscal_year")).agg(F.count(F.lit(1)).alias("n"))


@query()
def approx_distinct(spark, sf_dir):
    return C.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


# Incremental loads


@query("""WITH last AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM last WHERE s <> 'F')""")
def resume_pending(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "error").otherwise("done")
    tried = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("attempt"), status.alias("status"))
    return upserts.pending(C.table(spark, sf_dir, "customer").select("c_custkey"), tried, "c_custkey")


@query(f"""{OWN}, marked AS (SELECT company, owner, percent, CASE WHEN company % 3 = 0 THEN 'filed' ELSE 'listed' END AS source FROM ownership),
after AS (SELECT * FROM marked WHERE source <> 'listed' UNION ALL SELECT company, owner, percent / 2, 'listed' FROM marked WHERE source = 'listed' AND owner % 2 = 0)
SELECT 'edges' AS name, count(*) AS n, round(sum(percent), 6) AS total FROM after UNION ALL SELECT 'orphans', count(*), NULL FROM (SELECT DISTINCT owner FROM marked WHERE owner NOT IN (SELECT owner FROM after))""")
def replace_snapshot(spark, sf_dir):
    marked = C.ownership(spark, sf_dir).withColumn("source", F.when(F.col("company") % 3 == 0, "filed").otherwise("listed"))
    new = marked.where("source = 'listed' AND owner % 2 = 0").select("company", "owner", (F.col("percent") / 2).alias("percent"))
    after, orphans = upserts.replace_source(marked, new, "listed")
    edges = after.agg(F.lit("edges").alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum("percent"), 6).alias("total"))
    return edges.unionByName(orphans.agg(F.lit("orphans").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total")))


@query(f"""{YEARS}, have AS (SELECT ticker, max(fiscal_year) AS y FROM fin_years WHERE fiscal_year <= 1995 + suppkey % 7 AND suppkey % 4 <> 0 GROUP BY ticker)
SELECT f.ticker, f.fiscal_year FROM fin_years f LEFT JOIN have h USING (ticker) WHERE f.fiscal_year > coalesce(h.y, 0)""")
def newer_reports(spark, sf_dir):
    years = C.fin_years(spark, sf_dir)
    have = years.where("fiscal_year <= 1995 + suppkey % 7 AND suppkey % 4 <> 0")
    return upserts.newer_only(years.select("ticker", "fiscal_year"), have)


@query("""SELECT c_custkey, max(o_orderdate) AS last_run, max(o_orderdate) IS NULL OR DATE '1999-01-01' - CAST(max(o_orderdate) AS DATE) >= 30 AS due FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY c_custkey""")
def refresh_due(spark, sf_dir):
    runs = C.table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_run"))
    steps = C.table(spark, sf_dir, "customer").select("c_custkey").join(runs, "c_custkey", "left").withColumn("cadence_days", F.lit(30))
    return watch.due(steps, F.lit("1999-01-01").cast("date")).drop("cadence_days")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
u AS (SELECT query_id, vec_id, score, 0 AS priority FROM s WHERE label = 3 AND vec_id % 16 = 0 UNION ALL SELECT query_id, vec_id, score, 1 FROM s WHERE label = 7),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, score DESC, vec_id) AS place FROM u) SELECT query_id, vec_id, round(score, 6) AS score, priority, place FROM r WHERE place <= 8""", "place")
def stacked_hits(spark, sf_dir):
    emb, asked = C.table(spark, sf_dir, "embeddings"), asked_vectors(spark, sf_dir)
    best = lambda rows: vector.hits(rows, asked, 8, unscored=True).drop("place")
    first, second = best(emb.where("label = 3 AND vec_id % 16 = 0")), best(emb.where("label = 7"))
    return joins.stacked(first, second, ["query_id"], [F.desc("score"), F.col("vec_id")], 8).withColumn("score", F.round("score", 6))


@query(f"""{OWN}, h AS (SELECT 'S' || company AS company, CASE WHEN owner % 3 = 0 THEN (SELECT name FROM companies WHERE suppkey = owner) ELSE 'Holder ' || (owner % 10) END AS owner, percent, owner % 3 = 1 AS person FROM ownership),
l AS (SELECT h.company, coalesce(c.ticker, CASE WHEN person THEN owner || ' (' || h.company || ')' ELSE owner END) AS owner_key, CASE WHEN c.ticker IS NOT NULL THEN 'Company' WHEN person THEN 'Person' ELSE 'Organization' END AS owner_label, percent FROM h LEFT JOIN companies c ON lower(h.owner) = lower(c.name)),
r AS (SELECT *, row_number() OVER (PARTITION BY company, owner_key ORDER BY percent DESC) AS r FROM l WHERE company <> owner_key) SELECT company, owner_key, owner_label, round(percent, 8) AS percent FROM r WHERE r = 1""")
def link_owners(spark, sf_dir):
    names = C.companies(spark, sf_dir).select("suppkey", "ticker", "name")
    rows = C.ownership(spark, sf_dir).join(names.select(F.col("suppkey").alias("owner"), F.col("name").alias("owner_name")), "owner")
    owner = F.when(F.col("owner") % 3 == 0, F.upper("owner_name")).otherwise(F.concat(F.lit("Holder "), (F.col("owner") % 10).cast("string")))
    holders = rows.select(F.concat(F.lit("S"), F.col("company").cast("string")).alias("company"), owner.alias("owner"), "percent", F.when(F.col("owner") % 3 == 1, "person").otherwise("organisation").alias("kind"))
    return upserts.link_owners(holders, names).select("company", "owner_key", "owner_label", F.round("percent", 8).alias("percent"))
