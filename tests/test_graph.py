from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brasslark.operators import graph, joins, upserts, windows
from brasslark.plans import peers, scorecard, watch


def chain(spark, percents):
    rows = spark.createDataFrame([(0, list(range(len(percents) + 1)), percents)], "start long, path array<long>, percents array<double>")
    return graph.assembled(rows).first()


@pytest.mark.parametrize("percents, economic, control, reason", [([0.51, 0.51], 0.2601, True, "kept"), ([0.95, 0.40], 0.38, False, "kept"), ([0.5], 0.5, False, "kept"), ([0.51, None], None, None, "unknown_stake"), ([0.05, 0.05], 0.0025, False, "too_small")])
def test_chain_interest(spark, percents, economic, control, reason):
    r = chain(spark, percents)
    assert r["economic"] == (pytest.approx(economic) if economic is not None else None)
    assert r["control"] == control and r["reason"] == reason


def test_cycles_do_not_repeat_nodes(spark):
    stakes = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.6), (3, 1, 0.6)], "company long, owner long, percent double")
    rows = graph.chains(stakes, spark.createDataFrame([(1,)], "node long"), 4).collect()
    assert sorted(r["path"] for r in rows) == [[1, 2], [1, 2, 3]]


def test_shortest_path_skips_infrastructure(spark):
    edges = spark.createDataFrame([("a", "FILED", "b"), ("a", "SUPPLIED_BY", "c"), ("c", "SUPPLIED_BY", "b"), ("d", "LED_BY", "e")], "src string, rel string, dst string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "e")], "source string, target string")
    found = graph.shortest_paths(edges.withColumn("evidence", F.concat_ws(" ", "src", "dst")), pairs, targets=pairs).collect()
    assert [(r["hops"], r["path"], r["rels"], r["evidence"]) for r in found] == [(2, ["a", "c", "b"], ["SUPPLIED_BY", "SUPPLIED_BY"], ["a c", "c b"])]
    assert {r["target"] for r in graph.shortest_paths(edges, pairs).collect()} == {"b", "c"}


def test_neighbors_keep_direction_and_what_edges_say(spark):
    edges = spark.createDataFrame([("a", "SUPPLIED_BY", "b", "we buy", "d1", None), ("c", "OWNED_BY", "a", None, None, 0.3), ("a", "FILED", "f", None, None, None)], "src string, rel string, dst string, evidence string, doc_id string, percent double")
    rows = graph.neighbors(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert sorted((r["other"], r["direction"], r["evidence"], r["percent"]) for r in rows) == [("b", "out", "we buy", None), ("c", "in", None, 0.3)]


def test_ownership_network(spark):
    stakes = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.7), (4, 1, 0.55), (5, 1, 0.001), (6, 2, 0.5), (7, 8, None)], "company long, owner long, percent double")
    starts = spark.createDataFrame([(n,) for n in (1, 3, 7, 9)], "node long")
    got = {r["start"]: r for r in graph.network(stakes, starts).collect()}
    assert (got[1]["controllers"], got[1]["controlled"], got[1]["verdict"], got[1]["too_small"], got[1]["related"]) == ([2, 3], [4], "both", 1, 1)
    assert got[3]["verdict"] == "controls" and set(got[3]["controlled"]) == {1, 2, 4} and "no_owners" in got[3]["gaps"]
    assert got[7]["unknown_stakes"] == 1 and set(got[7]["gaps"]) == {"no_owners", "unknown_stakes", "no_holdings", "no_shared_owners"} and got[9]["verdict"] == "none"
    rows = graph.assembled(graph.chains(stakes, spark.createDataFrame([(4,)], "node long"), 3))
    assert [(r["direct"], r["place"], r["end"]) for r in graph.ranked(rows, 5).orderBy("direct", "place").collect()] == [(False, 1, 2), (False, 2, 3), (True, 1, 1)]


def rank(spark, subject, pool):
    rows = spark.createDataFrame([("s", subject), *((str(i), v) for i, v in enumerate(pool))], "ticker string, v double").withColumn("p", F.lit(1))
    return windows.rank_in(rows, ["p"], "v").where("ticker = 's'").first()


def test_rank_counts_the_subject(spark):
    r = rank(spark, 50.0, [10.0, 20.0, 30.0, 40.0])
    assert (r["rank"], r["n"], r["percentile"]) == (1, 5, 100.0)
    assert rank(spark, 5.0, [10.0, 20.0])["percentile"] == 0.0
    assert rank(spark, None, [10.0, 20.0]) is None


def test_currency_guard_keeps_all_for_an_unknown_subject(spark):
    companies = spark.createDataFrame([("s", "VND"), ("a", "VND"), ("b", "VND"), ("c", "USD"), ("d", "EUR"), ("u", None)], "ticker string, currency string")
    rows = spark.createDataFrame([(s, t) for s in ("s", "u") for t in "abcd"], "subject string, ticker string")
    kept = {(r["subject"], r["kept"]): r["count"] for r in peers.same_currency(rows, companies).groupBy("subject", "kept").count().collect()}
    assert kept == {("s", True): 2, ("s", False): 2, ("u", True): 4}


def test_series_signals(spark):
    obs = spark.createDataFrame([("R", "2024-01-01", 3.0), ("R", "2024-12-01", 4.0), ("O", "2024-01-01", 100.0), ("O", "2024-12-01", 115.0), ("X", "2024-01-01", 1.0), ("X", "2024-12-01", 2.0), ("S", "2020-01-01", 1.0)], "series_id string, date string, value double")
    obs = obs.withColumn("date", F.to_date("date"))
    limits = spark.createDataFrame([("R", "pp", 1.0, 30), ("O", "%", 30.0, 30), ("X", "%", 30.0, 30), ("S", "%", 1.0, 30), ("N", "%", 1.0, 30)], "series_id string, unit string, full double, max_age int")
    got = {r["series_id"]: (r["status"], r["change"], r["signal"]) for r in scorecard.series_signals(obs, limits, F.lit("2024-12-10").cast("date")).collect()}
    assert got == {"R": ("ok", 1.0, 1.0), "O": ("ok", 15.0, 0.5), "X": ("ok", 100.0, 1.0), "S": ("stale", None, None), "N": ("no_data", None, None)}


YEAR = "ticker string, sector string, currency string, profile string, fiscal_year int, revenue double, net_income double, stockholders_equity double, total_assets double, total_liabilities double, operating_cash_flow double, operating_income double, cash_and_equivalents double"


def company(ticker, profile, rows):
    return [(ticker, "S", "VND", profile, y, *map(float, r)) for y, r in rows]


def test_groups_of_three_companies_by_hand(spark):
    """Expected values are worked out by hand: a bank, an insurer, and an ordinary company whose latest year is a loss."""
    rows = company("BANK", "bank", [(2020, (100, 10, 80, 1000, 920, 1, 12, 50)), (2021, (110, 11, 90, 1000, 910, 1, 12, 50)), (2022, (121, 12.1, 100, 1000, 900, 1, 12, 50))])
    rows += company("INS", "insurer", [(2020, (100, 8, 100, 500, 400, 1, 9, 50)), (2021, (100, 8, 100, 500, 400, 1, 9, 50)), (2022, (100, 9, 100, 500, 400, 1, 9, 50))])
    rows += company("LOSS", "ordinary", [(2019, (100, -1, 50, 200, 150, 5, 5, 20)), (2020, (100, 10, 50, 200, 150, 6, 8, 20)), (2021, (100, 10, 50, 200, 150, 12, 8, 20)), (2022, (100, -5, 50, 200, 150, 1, 1, 20))])
    got = {r["ticker"]: r for r in scorecard.groups(spark.createDataFrame(rows, YEAR)).collect()}
    bank, ins, loss = got["BANK"], got["INS"], got["LOSS"]
    assert bank["growth"] == pytest.approx(((10 + 10) / 30 * 100 + (10 + 15) / 40 * 100) / 2)
    assert bank["profitability"] == pytest.approx(((12.1 - 5) / 15 * 100 + (1.21 - 0.5) / 1.5 * 100) / 2)
    assert bank["health"] == pytest.approx((10 - 5) / 7 * 100) and bank["stability"] == 100.0
    assert ins["profitability"] == pytest.approx((9 - 3) / 12 * 100) and ins["health"] == pytest.approx((20 - 10) / 25 * 100)
    assert ins["growth"] == pytest.approx((10 / 30 * 100 + ((9 / 8) ** 0.5 * 100 - 100 + 15) / 40 * 100) / 2)
    assert loss["growth"] == pytest.approx((10 / 30 * 100 + 0) / 2) and loss["stability"] == pytest.approx(0.0)
    assert loss["profitability"] == 0.0 and loss["health"] == pytest.approx((0.0 + 10 / 15 * 100) / 2)
    assert loss["earnings_quality"] == pytest.approx((0.6 + 1.2) / 2 / 1.2 * 100)


def test_a_loss_is_never_a_buy(spark):
    names = ["growth", "profitability", "health", "earnings_quality", "stability"]
    rows = [(*[90.0] * 5, "ordinary", 2024, income, equity) for income, equity in ((5.0, 5.0), (0.0, 5.0), (-1.0, 5.0), (5.0, 0.0), (5.0, None), (None, 5.0))]
    df = spark.createDataFrame(rows, ", ".join([*(f"{n} double" for n in names), "profile string", "latest_year int", "net_income double", "stockholders_equity double"]))
    assert [(r["level"], r["stopped"]) for r in scorecard.totals(df, 2024).collect()] == [("buy", False)] + [("watch", True)] * 5


def test_sector_list_and_counts(spark):
    rows = [("A", "S", 90.0, 30.0, 70.0, 50.0, 50.0, "ordinary", 2024, 1e6, 1.0, 1.0), ("B", "S", 80.0, 80.0, 80.0, 10.0, 80.0, "bank", 2024, 1e6, 1.0, 1.0), ("C", "S", 80.0, 80.0, 80.0, 80.0, 80.0, "ordinary", 2024, 10.0, 1.0, 1.0), ("D", "S", None, None, None, None, 1.0, "ordinary", 2024, 1e6, 1.0, 1.0)]
    df = scorecard.totals(spark.createDataFrame(rows, "ticker string, sector string, growth double, profitability double, health double, earnings_quality double, stability double, profile string, latest_year int, revenue double, net_income double, stockholders_equity double"), 2024)
    got = [(r["ticker"], r["place"], r["strong"], r["weak"]) for r in scorecard.sector_list(df, 10, 1000).orderBy("place").collect()]
    assert got == [("B", 1, ["growth", "profitability"], []), ("A", 2, ["growth", "health"], ["profitability"])]
    c = scorecard.sector_counts(df, 1000).first()
    assert (c["companies"], c["small"], c["unrated"], c["buy"], c["watch"], c["avoid"]) == (4, 1, 1, 1, 1, 0)


def test_pools_rank_as_pairs_of_peers_do(spark):
    import random

    rng = random.Random(3)
    companies = spark.createDataFrame([(f"T{i}", rng.choice("AB"), rng.choice("XY"), rng.choice(["USD", "EUR"])) for i in range(40)], "ticker string, sector string, market string, currency string").cache()
    money = lambda: rng.uniform(1, 100)
    years = [(f"T{i}", y, money(), rng.uniform(-5, 20), money(), rng.choice([None, 50.0, -3.0]), 200.0) for i in range(40) for y in range(2018, 2023) if rng.random() < 0.7]
    years = spark.createDataFrame(years, "ticker string, fiscal_year int, revenue double, net_income double, gross_profit double, stockholders_equity double, total_assets double")
    none = spark.createDataFrame([], "subject string, ticker string")
    key = lambda r: tuple((k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.asDict().items()))
    a, b = ({key(r) for r in f.collect()} for f in (peers.pooled(companies, companies, years), peers.named(companies, companies, years, none)))
    assert a == b and len(a) > 100


@pytest.mark.parametrize("score, level", [(70.0, "buy"), (69.9, "watch"), (45.0, "watch"), (44.9, "avoid")])
def test_levels(spark, score, level):
    names = ["growth", "profitability", "health", "earnings_quality", "stability", "industry", "macro"]
    rows = spark.createDataFrame([(*[score] * 7, "ordinary", 2024, 1.0, 1.0)], ", ".join([*(f"{n} double" for n in names), "profile string", "latest_year int", "net_income double", "stockholders_equity double"]))
    assert scorecard.totals(rows, 2025).first()["level"] == level
    assert scorecard.totals(rows, 2027).first()["level"] == "unrated"


def test_excluded_groups_do_not_lower_coverage(spark):
    rows = spark.createDataFrame([(50.0, 50.0, 50.0, None, 50.0, "bank", 2024, 1.0, 1.0), (50.0, None, None, None, None, "bank", 2024, 1.0, 1.0)], "growth double, profitability double, health double, earnings_quality double, stability double, profile string, latest_year int, net_income double, stockholders_equity double")
    got = [(r["coverage"], r["level"]) for r in scorecard.totals(rows, 2024).collect()]
    assert got[0] == (65 / 90, "watch") and got[1] == (20 / 90, "unrated")


def test_coverage_is_of_all_seven_groups(spark):
    """Unknown growth beside known groups, with industry and macro unknown, known, and without a column."""
    groups = "growth double, profitability double, health double, earnings_quality double, stability double"
    outside = "profile string, latest_year int, net_income double, stockholders_equity double"
    four = (None, 80.0, 80.0, 80.0, 80.0)
    rows = [(*four, *x, "ordinary", 2024, 1.0, 1.0) for x in ((None, None), (90.0, None), (None, 90.0), (90.0, 90.0))]
    got = [(r["coverage"], r["level"]) for r in scorecard.totals(spark.createDataFrame(rows, f"{groups}, industry double, macro double, {outside}"), 2024).collect()]
    assert got == [(0.55, "unrated"), (0.65, "unrated"), (0.7, "buy"), (0.8, "buy")]
    assert [r["level"] for r in scorecard.totals(spark.createDataFrame([(*four, "ordinary", 2024, 1.0, 1.0)], f"{groups}, {outside}"), 2024).collect()] == ["unrated"]


def test_sectors_give_industry_and_macro(spark):
    scores = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", None)], "ticker string, sector string")
    industry, macro = (spark.createDataFrame(rows, "sector string, score double") for rows in ([("X", 10.0)], [("X", None), ("Y", 20.0)]))
    assert {tuple(r) for r in scorecard.with_outside(scores, industry, macro).select("ticker", "industry", "macro").collect()} == {("a", 10.0, None), ("b", None, 20.0), ("c", None, None)}


def test_metric_changes(spark):
    s = "ticker string, fiscal_year int, metric string, value double"
    old = spark.createDataFrame([("A", 2020, "revenue", 100.0), ("A", 2020, "zero", 0.0), ("A", 2019, "revenue", 5.0)], s)
    new = spark.createDataFrame([("A", 2020, "revenue", 100.05), ("A", 2020, "zero", 9.0), ("A", 2019, "revenue", 6.0), ("A", 2021, "revenue", 1.0), ("A", 2020, "cash", 1.0), ("B", 2021, "revenue", 1.0)], s)
    got = {(r["fiscal_year"], r["metric"]): (r["kind"], r["severity"]) for r in watch.metric_changes(old, new).collect()}
    assert got == {(2019, "revenue"): ("restated", "high"), (2021, "revenue"): ("new_year", "high"), (2020, "cash"): ("new_metric", "medium")}


def test_holder_changes(spark):
    s = "ticker string, owner string, percent double"
    old = spark.createDataFrame([("A", "x", 0.10), ("A", "y", 0.10), ("A", "z", 0.10), ("A", "gone", 0.2)], s)
    new = spark.createDataFrame([("A", "x", 0.104), ("A", "y", 0.11), ("A", "z", 0.2), ("A", "big", 0.06), ("A", "small", 0.01)], s)
    got = {r["owner"]: (r["kind"], r["severity"]) for r in watch.holder_changes(old, new).collect()}
    assert got == {"y": ("changed", "medium"), "z": ("changed", "high"), "gone": ("gone_holder", "medium"), "big": ("new_holder", "high"), "small": ("new_holder", "medium")}


def test_upserts(spark):
    old = spark.createDataFrame([("A|1", 1.0, None)], "key string, a double, b double")
    new = spark.createDataFrame([("A|1", None, 2.0), ("B|1", 3.0, None)], "key string, a double, b double")
    assert sorted(map(tuple, upserts.upsert_years(old, new).collect())) == [("A|1", 1.0, 2.0), ("B|1", 3.0, None)]
    holders = spark.createDataFrame([("A", "Beta", 0.2, "org"), ("A", "Ann", 0.1, "person"), ("A", "Alpha", 0.3, "org")], "company string, owner string, percent double, kind string")
    names = spark.createDataFrame([("A", "alpha"), ("B", "Beta ")], "ticker string, name string")
    assert sorted((r["owner_key"], r["owner_label"]) for r in upserts.link_owners(holders, names).collect()) == [("Ann (A)", "Person"), ("B", "Company")]
    tried = spark.createDataFrame([("a", 1, "error"), ("a", 2, "empty"), ("b", 1, "error")], "k string, attempt int, status string")
    assert [r["k"] for r in upserts.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), tried, "k").orderBy("k").collect()] == ["b", "c"]
    have = spark.createDataFrame([("A", 2020)], "ticker string, fiscal_year int")
    assert upserts.newer_only(spark.createDataFrame([("A", 2020), ("A", 2021), ("B", 1)], "ticker string, fiscal_year int"), have).count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 100)), min_size=1, max_size=30))
def test_ranges_equal_a_plain_join(spark, found):
    rows = [(i, v) for i, (v, _) in enumerate(found)]
    ranges = [(lo, lo + w % 40, str(k)) for k, (lo, w) in enumerate(found)]
    got = joins.in_ranges(spark.createDataFrame(rows, "id long, v long"), "v", spark.createDataFrame(ranges, "lo long, hi long, name string"), 7)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted((i, n) for i, v in rows for lo, hi, n in ranges if lo <= v <= hi)


def test_peers_counted_by_pool_equal_pairs(spark):
    """Counts and years of pools equal those of pairs, with companies without currency, sector or market and with rivals of their own."""
    import random

    rng = random.Random(4)
    rows = [(f"T{i}", rng.choice(["A", "B", None]), rng.choice(["X", "Y", None]), rng.choice(["USD", "EUR", None])) for i in range(60)] + [("alone", "C", "X", "USD"), ("odd", "D", "X", "USD"), ("even", "D", "X", "EUR")]
    companies = spark.createDataFrame(rows, "ticker string, sector string, market string, currency string").cache()
    years = spark.createDataFrame([(t, y) for t, *_ in rows for y in range(2018, 2023) if rng.random() < 0.6], "ticker string, fiscal_year int").cache()
    rivals = spark.createDataFrame([("T1", f"T{i}") for i in (3, 4, 5, 6)] + [("T2", "T3")], "subject string, ticker string")
    pairs = peers.same_currency(peers.peer_sets(companies, companies, rivals), companies).cache()
    counts = pairs.groupBy("subject").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    ours = peers.currency_counts(companies, companies, rivals)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, counts.collect()))
    ours = peers.comparison_years(companies, companies, years, rivals)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, peers.comparison_year(pairs.where("kept"), years).collect()))
