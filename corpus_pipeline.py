"""A pipeline from raw documents to packed bins. Each stage is an operator of brasslark.llm over all its predecessor kept.

Whole texts go through frames that run after a stage has returned them, so every stage leaves the session with small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasslark.llm import exact, langid, mixing, packing, similar
from brasslark.llm.common import fresh, saved, small_batches, table

#: Cosines with the best language that chance gives too: three times the spread of a random vector's cosine.
MIN_COSINE = 3 / langid.DIM**0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those no more like a language than chance makes them; profiles are learned from the rows that op5 learns from."""
    small_batches(spark)
    train = docs.where(~langid.held_out(F.col("doc_id"), 4, 2))
    lang, score = names = fresh(docs, "lang_pred", "score")
    judged = langid.predict(docs, langid.train(train), *docs.columns, names=names)
    return judged.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_COSINE)).drop(*names)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    small_batches(spark)
    index = exact.DigestIndex.temporary(spark)
    kept = exact.drop_duplicates(docs, index)
    index.drop()
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group joined by pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return similar.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets."""
    small_batches(spark)
    return mixing.mix(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact_duplicates), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("best-fit packing", bins)]

#: Trained profiles, fingerprints and the order of packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
