from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from brasslark.llm.common import BATCH
from brasslark.llm.queries import QUERIES
from tests.conftest import SMALL


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_on_awkward_rows(spark, docs, none):
    ids = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert {r["doc_id"] for r in out.collect()} <= ids, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        assert stage(spark, none, SMALL).count() == 0, name


def test_clean_documents_stay(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SMALL).collect()}
    assert set(range(60)) <= kept and not kept & {63, 64, 65, 66}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    used = Counter()
    for r in rows:
        used[r["bin_id"]] += r["n_words"]
    assert rows and all(n <= 2048 for b, n in used.items() if b)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lang = stages["language ID"](spark, docs, SMALL)
    exact = stages["exact dedup"](spark, lang, SMALL)
    assert exact.count() == exact.select("text").distinct().count() == lang.select("text").distinct().count()
    near = stages["SimHash near-dedup"](spark, exact, SMALL)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in near.select("doc_id").collect()}
    assert near.join(docs, "doc_id", "left_anti").count() == 0 and near.where(F.col("text").isNull()).count() == 0


def test_stages_take_few_texts_at_once(spark, docs):
    """The usual batches of whole texts filled an executor's memory; a stage's frame runs after the stage has returned it."""
    names = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        for name, rows in zip(names, ("4096", "0"), strict=True):
            spark.conf.set(name, rows)
        stage(spark, docs, SMALL)
        assert [spark.conf.get(name) for name in names] == [str(BATCH)] * 2
    for name in names:
        spark.conf.set(name, "7")
    corpus_pipeline.mixture(spark, docs, SMALL)
    assert [spark.conf.get(name) for name in names] == ["7", "7"]  # smaller ones stay
    for name in names:
        spark.conf.unset(name)
