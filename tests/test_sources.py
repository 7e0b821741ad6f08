"""Archives, versioned tables and keyed tables."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from brasslark import catalog as C
from brasslark.plans import financials, peers
from brasslark.sources import bulk, store, xbrl
from brasslark.sources.versions import Conflict, Manifest, VersionedTable
from tests.conftest import SMALL


def filed(cik: int, years: range) -> dict:
    rows = [{"start": f"{y}-01-01", "end": f"{y}-12-31", "val": float(cik * y), "accn": f"a{y}", "fy": y, "fp": "FY", "form": "10-K"} for y in years]
    return {"entityName": f"Company {cik}", "facts": {"us-gaap": {"Revenues": {"units": {"USD": rows}}}}}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bulk")
    (folder / "plain").mkdir()
    with zipfile.ZipFile(folder / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for cik in range(1, 8):
            text = json.dumps(filed(cik, range(2010, 2022)))
            z.writestr(f"sub/CIK{cik:010}.json", text)
            (folder / "plain" / f"CIK{cik:010}.json").write_text(text)
        z.writestr("CIK0000000008.json", "")
        z.writestr("CIK0000000009.json", b"\xff\xfe broken")
    return folder


def test_members_equal_the_unzipped_read(spark, archive):
    rows = bulk.members(spark, f"{archive}/all.zip", run=300)
    assert rows.rdd.getNumPartitions() > 3
    unzipped = xbrl.facts(xbrl.read(spark, f"{archive}/plain"))
    zipped = xbrl.facts(rows.where("json is not null").select(F.col("member").alias("ticker"), "json"))
    assert sorted(map(tuple, zipped.collect())) == sorted(map(tuple, unzipped.collect())) and zipped.count() == 7 * 12


def test_min_year_and_members_asked_for(spark, archive):
    late = bulk.members(spark, f"file://{archive}/all.zip", min_year=2018).where("json is not null and error is null")
    facts = xbrl.facts(late.select(F.col("member").alias("ticker"), "json"))
    assert {r["fiscal_year"] for r in facts.collect()} == {2018, 2019, 2020, 2021}
    one = bulk.members(spark, f"{archive}/all.zip", run=1).where("member = 'CIK0000000003'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1


def test_companies_without_figures_are_counted(spark, archive):
    universe = spark.createDataFrame([(f"T{i}", str(i)) for i in (1, 8, 9, 77)], "ticker string, cik string")
    got = {r["ticker"]: (r["status"], r["json"] is None) for r in bulk.companies(universe, bulk.members(spark, f"{archive}/all.zip")).collect()}
    assert got == {"T1": ("ok", False), "T8": ("empty", True), "T9": ("broken", True), "T77": ("missing", True)}


def add_up(old, new):
    return old.unionByName(new.select(*old.columns)).groupBy("k").agg(F.sum("n").alias("n"))


def table(spark, path):
    return VersionedTable(spark, f"{path}/t", "k long, n long", ["k"], 4)


def counts(t, version=None):
    return {r["k"]: r["n"] for r in t.read(version).collect()}


def test_a_table_can_be_changed_by_its_own_rows(spark, tmp_path):
    t = table(spark, tmp_path)
    assert counts(t) == {} and t.latest() == Manifest(0, {}, {})
    t.upsert(spark.range(20).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    t.upsert(t.read().where("k < 3").withColumn("n", F.col("n") + 10))
    assert counts(t) == {k: 11 if k < 3 else 1 for k in range(20)} and counts(t, 1) == dict.fromkeys(range(20), 1)
    first, second = t.manifest(1).folders, t.latest().folders
    t.upsert(spark.createDataFrame([(5, 7)], "k long, n long"))
    assert sum(t.latest().folders[b] != second[b] for b in second) == 1 and set(first) == set(second)  # one bucket is written anew
    t.change(spark.createDataFrame([(5, 0)], "k long, n long"), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert 5 not in counts(t) and len(counts(t)) == 19
    assert t.vacuum() >= 1 and len(counts(t)) == 19


def test_a_batch_twice_is_a_version_once(spark, tmp_path):
    t, rows = table(spark, tmp_path), spark.createDataFrame([(1, 5), (2, 6)], "k long, n long")
    for batch in (0, 0, 1, 1, 0):
        t.change(rows, add_up, "w", batch)
    t.change(rows, add_up, "other", 0)
    assert counts(t) == {1: 15, 2: 18} and t.latest().version == 3


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    t, rows = table(spark, tmp_path), spark.createDataFrame([(1, 5)], "k long, n long")
    t.upsert(rows)
    with pytest.raises(Exception, match="broken on purpose"):
        t.change(rows, lambda old, new: old.withColumn("n", F.raise_error(F.lit("broken on purpose")).cast("long")))
    assert counts(t) == {1: 5} and t.latest().version == 1
    with pytest.raises(Conflict):
        t._publish(Manifest(1, {}, {}))


def test_streamed_merges_equal_one_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 17).alias("k"), F.col("id").alias("n"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    t = table(spark, tmp_path)
    stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        stream.writeStream.foreachBatch(t.sink("s", add_up)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert t.latest().version == 3 and counts(t) == {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("n").alias("s")).collect()}


def test_edges_are_merged_into_a_stored_table(spark, tmp_path):
    schema = "src string, rel string, dst string, mentions long, confidence double"
    t = VersionedTable(spark, f"{tmp_path}/edges", schema, ["src", "rel", "dst"], 4)
    new = spark.createDataFrame([("a", "r", "b", 2, 0.5), ("a", "r", "c", 1, 0.9)], schema)
    merge = lambda old, rows: old.unionByName(rows).groupBy("src", "rel", "dst").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"))
    for batch in (0, 1, 1):
        t.change(new, merge, "extractor", batch)
    assert {tuple(r) for r in t.read().collect()} == {("a", "r", "b", 4, 0.5), ("a", "r", "c", 2, 0.9)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return [line.strip() for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


def test_keyed_tables_need_no_shuffle(spark, tmp_path):
    years = C.fin_years(spark, SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        figures = store.KeyedTable(spark, "years_keyed", f"{tmp_path}/years", "ticker", 4).write(years, "fiscal_year")
        names = store.KeyedTable(spark, "names_keyed", f"{tmp_path}/names", "ticker", 4).write(C.companies(spark, SMALL).select("ticker"))
        looked = financials.lookup(figures.read(), names.read(), ["revenue"])
        assert not exchanges(looked) and sorted(looked.collect()) == sorted(financials.lookup(years, C.companies(spark, SMALL), ["revenue"]).collect())
        compared = financials.compare(figures.read(), names.read(), "revenue", 1997)
        assert not any("ticker" in e for e in exchanges(compared)) and "PartitionFilters: [isnotnull(fiscal_year" in plan(compared)
        assert sorted(compared.collect()) == sorted(financials.compare(years, C.companies(spark, SMALL), "revenue", 1997).collect())
        files = figures.read().where("fiscal_year = 1997").select("revenue").inputFiles()
        assert files and all("fiscal_year=1997" in f for f in files)
        figures.drop()
        names.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reasons_are_counted_on_the_screen_s_own_pass(spark):
    years, filters = C.fin_years(spark, SMALL), [("net_income", "gt", 0), ("revenue", "gte", 100_000), ("bad", "gt", 1)]
    top, counts = financials.screen_observed(years, filters, 1997, "revenue")
    rows = top.collect()
    assert rows == financials.screen(years, filters, 1997, "revenue").collect()
    want = {r["reason"]: r["n"] for r in financials.screened_out(years, filters, 1997).collect()}
    assert {k: v for k, v in counts.get.items() if v} == want


def test_an_ingest_is_counted_as_it_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", None), (None, None)], "k string, v long")
    out, counts = store.counted(rows, no_key=F.col("k").isNull(), no_value=F.col("v").isNull())
    out.write.parquet(f"{tmp_path}/x")
    assert counts.get == {"n": 4, "no_key": 2, "no_value": 2}


def test_peer_table_says_how_many_more(spark):
    years = spark.createDataFrame([(f"T{i}", "x", float(i)) for i in range(14)] + [("U", "x", None), ("V", "y", 1.0)], "ticker string, pool string, revenue double")
    rows = {(r["pool"], r["place"]): (r["ticker"], r["rest"]) for r in peers.table(years, ["pool"]).collect()}
    assert len(rows) == 11 and rows["x", 1] == ("T13", 4) and rows["y", 1] == ("V", 0)
