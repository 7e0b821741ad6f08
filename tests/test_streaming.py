from __future__ import annotations

from pyspark.sql import functions as F

from brasslark.streaming import events as S
from tests.conftest import SMALL


def landed(spark, tmp_path, parts=3):
    folder = f"{tmp_path}/in"
    spark.read.parquet(f"{SMALL}/events.parquet").repartitionByRange(parts, "ts").write.parquet(folder)
    return folder


def test_tumbling_equals_batch(spark, tmp_path):
    folder = landed(spark, tmp_path)
    stream = S.tumbling(S.read_parquet(spark, folder, 10))
    S.run_available(stream.withColumn("total", F.round("total", 4)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= 0.9 * len(want)


def test_ledger_takes_each_event_once(spark, tmp_path):
    folder = landed(spark, tmp_path, 1)
    spark.read.parquet(folder).write.mode("append").parquet(folder)
    S.run_available(S.first_seen(S.read_parquet(spark, folder, 10)), f"{tmp_path}/out", f"{tmp_path}/cp")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("event_id").distinct().count() == 1000


def test_restatements(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 100.05), ("a", 3, 90.0), ("b", 1, 5.0), ("c", 1, None)], "key string, ts int, value double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.restatements(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    S.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r["key"], r["kind"], r["new"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "baseline", 100.0), ("a", "restated", 90.0), ("b", "baseline", 5.0)]


def test_sliding_and_session_windows_stay_within_batch(spark, tmp_path):
    folder = landed(spark, tmp_path)
    S.run_available(S.sliding(S.read_parquet(spark, folder, 10)), f"{tmp_path}/a", f"{tmp_path}/ca")
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").count()
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/a").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    S.run_available(S.sessions(S.read_parquet(spark, folder, 10)), f"{tmp_path}/b", f"{tmp_path}/cb")
    own = spark.read.parquet(folder).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").count()
    want = {(r["user_id"], r["w"]["start"]): r["count"] for r in own.collect()}
    got = {(r["user_id"], r["start"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/b").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_static_join_and_corrupt_lines(spark, tmp_path):
    folder = landed(spark, tmp_path, 1)
    users = spark.read.parquet(folder).select("user_id").distinct().withColumn("name", F.concat(F.lit("u"), "user_id"))
    S.run_available(S.with_dimension(S.read_parquet(spark, folder), users), f"{tmp_path}/out", f"{tmp_path}/cp")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 1000 and out.where("name is null").count() == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text('{"event": "turn"}\n{"event": \n')
    S.run_available(S.read_json(spark, f"{tmp_path}/logs", "event string"), f"{tmp_path}/l", f"{tmp_path}/cl")
    assert sorted((r["event"], r["_corrupt"] is None) for r in spark.read.parquet(f"{tmp_path}/l").fillna("?", ["event"]).collect()) == [("?", False), ("turn", True)]


def test_newest_only_in_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2020), ("a", 2022), ("b", 2019)], "key string, fiscal_year int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = {}
    stream = S.newest_only(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r["key"]: r["newest"] for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": 2022, "b": 2019}
