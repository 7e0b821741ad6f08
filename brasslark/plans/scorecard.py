"""The published scorecard: groups of 0 to 100, weighted over what is known, with coverage and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.functions.numbers import cagr_pct, divide, held, scale
from brasslark.operators.joins import in_ranges
from brasslark.operators.windows import with_share_below
from brasslark.sources.scratch import saved

#: Group weights, levels (lowest score of each, best first) and limits.
WEIGHTS = {"growth": 20.0, "profitability": 20.0, "health": 15.0, "earnings_quality": 10.0, "stability": 10.0, "industry": 10.0, "macro": 15.0}
LEVELS = ((70.0, "buy"), (45.0, "watch"), (0.0, "avoid"))
MIN_COVERAGE, MIN_YEARS, MIN_PEERS, STALE_YEARS = 0.70, 3, 5, 2
EXCLUDED = {"bank": ("earnings_quality",), "insurer": ("earnings_quality",), "ordinary": ()}
OUTLIER_GROWTH = 150.0
#: World series with unit (pp: points, else percent), the change that is a full signal, and oldest age in days.
SERIES = {"DFF": ("pp", 1.0, 14), "DGS10": ("pp", 1.0, 14), "DTWEXBGS": ("%", 8.0, 21), "DCOILBRENTEU": ("%", 30.0, 14), "CPIAUCSL": ("%", 3.0, 100), "WPU101": ("%", 15.0, 100), "PCOPPUSDM": ("%", 20.0, 130), "PRUBBUSDM": ("%", 20.0, 130), "RSAFS": ("%", 5.0, 100)}
LOOKBACK_DAYS = 182
#: What a rise of a series does to a sector.
SENSITIVITY = {
    "Real Estate": {"DFF": -1.0, "DGS10": -1.0}, "Banks": {"DFF": -0.5, "DTWEXBGS": -0.5}, "Financial Services": {"DFF": -1.0, "DTWEXBGS": -0.5}, "Insurance": {"DGS10": 0.5},
    "Basic Materials": {"WPU101": 1.0, "PCOPPUSDM": 0.5, "PRUBBUSDM": 0.5}, "Oil & Gas": {"DCOILBRENTEU": 1.0}, "Industrials": {"DCOILBRENTEU": -0.5, "DTWEXBGS": -0.5, "RSAFS": 0.5},
    "Consumer Goods": {"RSAFS": 1.0, "DCOILBRENTEU": -0.5}, "Consumer Services": {"DCOILBRENTEU": -1.0, "DTWEXBGS": -0.5}, "Utilities": {"DCOILBRENTEU": -0.5}, "Technology": {"RSAFS": 0.5, "DFF": -0.5},
    "Health Care": {"DTWEXBGS": -0.5}, "Telecommunications": {"DTWEXBGS": -0.5},
}
#: Industry code ranges of each sector, both ends included.
SECTOR_CODES = {
    "Banks": ((6020, 6029), (6035, 6036)), "Financial Services": ((6200, 6211), (6282, 6282)), "Insurance": ((6311, 6411),), "Real Estate": ((6500, 6553), (6798, 6798)),
    "Technology": ((7370, 7379), (3570, 3579), (3670, 3679)), "Telecommunications": ((4810, 4899),), "Oil & Gas": ((1311, 1311), (1381, 1389), (2911, 2911), (4922, 4924)), "Utilities": ((4911, 4991),),
    "Basic Materials": ((3310, 3317), (3330, 3399), (2800, 2829), (2860, 2899), (1000, 1099), (1400, 1499), (3010, 3069)),
    "Industrials": ((1500, 1799), (3400, 3569), (3580, 3599), (3700, 3799), (4000, 4789), (8700, 8748)), "Consumer Goods": ((2000, 2199), (2200, 2399), (2840, 2844), (3140, 3149), (3630, 3639)),
    "Consumer Services": ((5200, 5999), (4512, 4513), (7000, 7099), (7800, 7999)), "Health Care": ((2830, 2836), (3840, 3851), (8000, 8099)),
}
#: Names of sectors as people write them.
SECTOR_ALIASES = {
    "ngân hàng": "Banks", "ngan hang": "Banks", "bank": "Banks", "banks": "Banks", "bảo hiểm": "Insurance", "bao hiem": "Insurance", "insurance": "Insurance", "chứng khoán": "Financial Services", "chung khoan": "Financial Services",
    "tài chính": "Financial Services", "financial services": "Financial Services", "bất động sản": "Real Estate", "bat dong san": "Real Estate", "real estate": "Real Estate", "công nghệ": "Technology", "cong nghe": "Technology",
    "technology": "Technology", "viễn thông": "Telecommunications", "telecommunications": "Telecommunications", "dầu khí": "Oil & Gas", "dau khi": "Oil & Gas", "oil & gas": "Oil & Gas", "điện": "Utilities", "tiện ích": "Utilities",
    "utilities": "Utilities", "thép": "Basic Materials", "vật liệu": "Basic Materials", "nguyên vật liệu": "Basic Materials", "hóa chất": "Basic Materials", "basic materials": "Basic Materials", "công nghiệp": "Industrials",
    "xây dựng": "Industrials", "industrials": "Industrials", "hàng tiêu dùng": "Consumer Goods", "thực phẩm": "Consumer Goods", "consumer goods": "Consumer Goods", "bán lẻ": "Consumer Services",
    "dịch vụ tiêu dùng": "Consumer Services", "hàng không": "Consumer Services", "consumer services": "Consumer Services", "y tế": "Health Care", "dược": "Health Care", "health care": "Health Care",
}


def sector_name(c: Column) -> Column:
    """The sector that a name stands for, or the name itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTOR_ALIASES.items() for x in kv]), F.lower(F.trim(c))), c)


def profile(sector: Column) -> Column:
    return F.when(sector == "Banks", "bank").when(sector == "Insurance", "insurer").otherwise("ordinary")


def mean_known(*parts: Column) -> Column:
    """Mean of the parts that are known; NULL if none is."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


#: Worst and best of the ratios that depend on the profile, in percent.
ROE = {"bank": (5, 20), "insurer": (3, 15), "ordinary": (0, 20)}
EQUITY_SHARE = {"bank": (5, 12), "insurer": (10, 35)}


def by_profile(value: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """The value on the scale of the row's profile; NULL for a profile without one."""
    out = F.lit(None).cast("double")
    for name, (worst, best) in ranges.items():
        out = F.when(F.col("profile") == name, scale(value, worst, best)).otherwise(out)
    return out


def groups(years: DataFrame) -> DataFrame:
    """ticker, sector, currency, profile, latest_year, revenue, net_income, stockholders_equity and the five groups that a company's own figures give, for its latest year.

    years has a profile (bank, insurer or ordinary) beside the figures. Percentiles are taken among companies of the
    sector, year and currency. Fewer than MIN_YEARS years leave growth and stability unknown. Losses are counted over all
    years, margins over the last five, cash conversion over the last three with a profit.
    """
    c = F.col
    margin = F.when(c("revenue") > 0, divide(c("net_income") * 100.0, c("revenue")))
    rows = years.withColumn("margin", margin).withColumn("roe", F.when(c("stockholders_equity") > 0, divide(c("net_income") * 100.0, c("stockholders_equity"))))
    for name in ("roe", "margin"):
        rows = saved(with_share_below(rows, ["sector", "currency", "fiscal_year"], name, f"{name}_pct", MIN_PEERS), "shares")
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("fiscal_year")))
    rows = rows.withColumn("back", back)
    last = lambda x, n: F.when(c("back") <= n, x)
    first = lambda x: F.min_by(last(c(x), 5), last(c("fiscal_year"), 5))
    latest = ("revenue", "net_income", "roe", "roe_pct", "margin_pct", "stockholders_equity", "total_liabilities", "total_assets", "operating_income", "cash_and_equivalents")
    per = rows.groupBy("ticker", "sector", "currency", "profile").agg(
        F.max("fiscal_year").alias("latest_year"),
        F.count(F.lit(1)).alias("n_years"),
        first("revenue").alias("rev0"),
        first("net_income").alias("ni0"),
        (F.max("fiscal_year") - F.min(last(c("fiscal_year"), 5))).cast("double").alias("span"),
        *[F.max_by(x, "fiscal_year").alias(x) for x in latest],
        F.avg(F.when((c("back") <= 3) & (c("net_income") > 0), divide(c("operating_cash_flow"), c("net_income")))).alias("conversion"),
        F.count_if(F.coalesce(c("net_income") < 0, F.lit(False))).alias("losses"),
        F.count(last(c("margin"), 5)).alias("n_margin"),
        F.avg(last(c("margin"), 5)).alias("mean_margin"),
        F.stddev_pop(last(c("margin"), 5)).alias("sd_margin"),
    )
    enough, ordinary = c("n_years") >= MIN_YEARS, c("profile") == "ordinary"
    income, equity, assets = c("net_income"), c("stockholders_equity"), c("total_assets")
    profit = F.when(income <= 0, 0.0).when((c("ni0") <= 0) & (income > 0), 60.0).otherwise(scale(cagr_pct(c("ni0"), income, c("span")), -15, 25))
    roe = F.when(equity <= 0, 0.0).otherwise(by_profile(c("roe"), ROE))
    roa = scale(divide(income * 100.0, assets), 0.5, 2.0)
    debt = F.when(equity <= 0, 0.0).otherwise(scale(divide(c("total_liabilities"), equity), 3, 0.5))
    cash = scale(divide(c("cash_and_equivalents") * 100.0, assets), 0, 15)
    core = F.when(income > 0, scale(divide(c("operating_income"), income), 0.6, 1.0))
    cv = F.when((c("n_margin") >= 4) & (c("mean_margin") > 0), divide(c("sd_margin"), c("mean_margin")))
    return per.select(
        "ticker", "sector", "currency", "profile", "latest_year", "revenue", "net_income", "stockholders_equity",
        F.when(enough, mean_known(scale(cagr_pct(c("rev0"), c("revenue"), c("span")), -10, 20), profit)).alias("growth"),
        mean_known(roe, c("roe_pct"), F.when(c("profile") == "bank", roa).otherwise(c("margin_pct"))).alias("profitability"),
        F.when(ordinary, mean_known(debt, cash)).otherwise(by_profile(divide(equity * 100.0, assets), EQUITY_SHARE)).alias("health"),
        mean_known(scale(c("conversion"), 0, 1.2), core).alias("earnings_quality"),
        F.when(enough, mean_known(F.when(c("losses") == 0, 100.0).when(c("losses") == 1, 50.0).otherwise(0.0), scale(cv, 1.0, 0.15))).alias("stability"),
    )


def totals(scores: DataFrame, as_of_year: int) -> DataFrame:
    """scores (group columns, profile) with coverage, score and level: weights of unknown groups are shared out, excluded ones don't count; low coverage or stale figures leave the company unrated.

    Coverage is of all seven groups that the profile has, whether scores has their columns or not: a group without a column is unknown.
    A company with a loss or no income in its latest year, or without equity, is never better than "watch"; `stopped` says so.
    """
    scores = scores.withColumns({g: F.lit(None).cast("double") for g in WEIGHTS if g not in scores.columns})
    names = list(WEIGHTS)
    applies = {g: ~F.coalesce(F.col("profile").isin(*[p for p, x in EXCLUDED.items() if g in x] or [""]), F.lit(False)) for g in names}
    weight = lambda g, ok: F.when(ok, WEIGHTS[g]).otherwise(0.0)
    total = lambda xs: sum(xs[1:], xs[0])
    used = total([weight(g, applies[g] & F.col(g).isNotNull()) for g in names])
    possible = total([weight(g, applies[g]) for g in names])
    points = total([F.coalesce(F.when(applies[g], F.col(g) * WEIGHTS[g]), F.lit(0.0)) for g in names])
    rows = scores.withColumn("coverage", divide(used, possible)).withColumn("score", divide(points, used))
    level = F.when((F.col("coverage") < MIN_COVERAGE) | F.col("score").isNull() | (F.lit(as_of_year) - F.col("latest_year") > STALE_YEARS), "unrated")
    for least, name in LEVELS:
        level = level.when(F.col("score") >= least, name)
    rows = rows.withColumn("level", level)
    held_back = (F.coalesce("net_income", F.lit(0.0)) <= 0) | (F.coalesce("stockholders_equity", F.lit(0.0)) <= 0)
    rows = rows.withColumn("stopped", (F.col("level") == LEVELS[0][1]) & held_back)
    return rows.withColumn("level", F.when(F.col("stopped"), LEVELS[1][1]).otherwise(F.col("level")))


def with_outside(scores: DataFrame, industry: DataFrame, macro: DataFrame) -> DataFrame:
    """scores with the groups that a company gets from its sector: industry and macro (sector, score each); NULL where the sector has none."""
    for name, outside in (("industry", industry), ("macro", macro)):
        scores = scores.join(outside.select("sector", F.col("score").alias(name)), "sector", "left")
    return scores


def sector_list(rated: DataFrame, top: int = 10, least: float = 0.0) -> DataFrame:
    """Per sector the `top` companies of rated (totals with revenue) that have a level and at least that revenue, best score first, ties by ticker.

    Adds place, strong and weak: of the two best groups those of 60 or more, of the two worst those under 45.
    """
    names = [g for g in WEIGHTS if g in rated.columns]
    known = F.array_compact(F.array(*[F.when(F.col(g).isNotNull() & ~F.coalesce(F.col("profile").isin(*[p for p, x in EXCLUDED.items() if g in x] or [""]), F.lit(False)), F.struct(F.col(g).alias("score"), F.lit(-k).alias("order"), F.lit(g).alias("name"))) for k, g in enumerate(names)]))
    ranked = F.sort_array(known, asc=False)
    name = lambda xs: F.transform(xs, lambda x: x["name"])
    strong = name(F.filter(F.slice(ranked, 1, 2), lambda x: x["score"] >= 60))
    size = F.size(ranked)
    weak = name(F.filter(F.slice(ranked, F.greatest(size - 1, F.lit(1)), F.lit(2)), lambda x: x["score"] < 45))
    fit = rated.where((F.col("level") != "unrated") & (F.coalesce("revenue", F.lit(0.0)) >= least))
    w = Window.partitionBy("sector").orderBy(F.desc("score"), "ticker")
    return fit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).withColumn("strong", strong).withColumn("weak", weak)


def sector_counts(rated: DataFrame, least: float = 0.0) -> DataFrame:
    """sector, companies, small, unrated and one count a level: every company of the sector is counted in one of them."""
    small = F.coalesce("revenue", F.lit(0.0)) < least
    rated_ = F.col("level") != "unrated"
    levels = [F.count_if(rated_ & ~small & (F.col("level") == name)).alias(name) for _, name in LEVELS]
    return rated.groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.count_if(rated_ & small).alias("small"), F.count_if(~rated_).alias("unrated"), *levels)


def series_signals(obs: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """series_id, status, latest, change, signal over obs (series_id, date, value), limits (series_id, unit, full, max_age).

    The base is the latest value at least LOOKBACK_DAYS before the newest one. Rates change in points, the rest in percent; a signal is held to -1..1.
    """
    newest = obs.where(F.col("date") <= as_of).groupBy("series_id").agg(F.max_by("value", "date").alias("latest"), F.max("date").alias("latest_date"))
    j = obs.join(newest, "series_id").where(F.col("date") <= F.date_sub("latest_date", LOOKBACK_DAYS))
    base = j.groupBy("series_id").agg(F.max_by("value", "date").alias("base"))
    rows = limits.join(newest, "series_id", "left").join(base, "series_id", "left")
    change = F.when(F.col("unit") == "pp", F.col("latest") - F.col("base")).otherwise(divide((F.col("latest") - F.col("base")) * 100.0, F.abs("base")))
    status = F.when(F.col("latest").isNull(), "no_data").when(F.datediff(as_of, "latest_date") > F.col("max_age"), "stale").when(F.col("base").isNull(), "short_history").when(change.isNull(), "not_computable").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("change", F.when(status == "ok", change))
    return rows.select("series_id", "status", "latest", "base", "change", held(divide(F.col("change"), F.col("full")), -1.0, 1.0).alias("signal"))


def macro_scores(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """sector, score, used, dropped over weights (sector, series_id, weight): 50 is neutral; no usable series is NULL, not 50."""
    j = weights.join(signals, "series_id", "left")
    ok = F.col("status") == "ok"
    raw = divide(F.sum(F.when(ok, F.col("weight") * F.col("signal"))), F.sum(F.when(ok, F.abs("weight"))))
    return j.groupBy("sector").agg((50.0 + 50.0 * raw).alias("score"), F.count_if(ok).alias("used"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("dropped"))


def industry_scores(years: DataFrame, codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """sector, companies, outliers, growth, margin_change, score: medians over companies whose code (ticker, code) lies in a range (sector, lo, hi), between their last two years."""
    margin = divide(F.col("net_income") * 100.0, F.col("revenue"))
    w = Window.partitionBy("ticker").orderBy(F.desc("period_end"), F.desc("fiscal_year"))
    last = years.withColumn("margin", margin).withColumn("r", F.row_number().over(w)).where("r <= 2")
    two = last.groupBy("ticker").agg(*[F.max(F.when(F.col("r") == r, F.col(x))).alias(f"{x}{r}") for x in ("revenue", "margin") for r in (1, 2)])
    two = two.select("ticker", divide((F.col("revenue1") - F.col("revenue2")) * 100.0, F.abs("revenue2")).alias("g"), (F.col("margin1") - F.col("margin2")).alias("m")).where("g is not null")
    placed = in_ranges(codes, "code", ranges).select("ticker", "sector").distinct().join(two, "ticker").withColumn("out", F.abs("g") > OUTLIER_GROWTH)
    fit = F.when(~F.col("out"), F.col("g"))
    per = placed.groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.count_if("out").alias("outliers"), F.median(fit).alias("growth"), F.median(F.when(~F.col("out"), F.col("m"))).alias("margin_change"))
    return per.withColumn("score", 0.6 * scale(F.col("growth"), -10, 20) + 0.4 * scale(F.col("margin_change"), -5, 5))
