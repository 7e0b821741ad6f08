"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. A batch of new documents is reduced
to one winner a digest, anti-joined with the index by sort-merge (the index side needs no shuffle), and the
new digests are appended. Of equal texts in a batch the row with the largest doc_id wins; a text that the
index already holds from another batch keeps the winner it has.

Every entry names the batch that brought it, and a batch never loses to its own entries: if a job is lost
after the append, running the batch again under its name gives the same rows and leaves the index as it is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasslark.llm.common import keep_first, salted, saved, scratch_path, spread_join


def digest(text: Column) -> Column:
    """SHA-256 of the unchanged text in UTF-8 as lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """The persistent index: (digest, doc_id, batch), bucketed and sorted by digest, in a table over `path`.

    The table is made where it is missing, so another session that names the same path goes on with what is there.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        """buckets: chosen once, when the index is made; enough that a bucket fits a task as the index grows."""
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, doc_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "digests"), buckets)

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, entries: DataFrame, batch: str | None = None) -> DataFrame:
        """The entries whose digest no other batch has brought (no batch at all without `batch`)."""
        held = self.table() if batch is None else self.table().where(F.col("batch") != batch)
        return entries.hint("merge").join(held.select("digest"), "digest", "left_anti")

    def append(self, entries: DataFrame, batch: str) -> None:
        """entries: (digest, doc_id), one row a digest. Those the index holds already are left out. One file a bucket and append."""
        rows = self.unseen(entries.select("digest", "doc_id")).withColumn("batch", F.lit(batch))
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def _digests(docs: DataFrame) -> DataFrame:
    return salted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")


def _groups(rows: DataFrame) -> DataFrame:
    """digest, doc_id (the largest), group_size; copies are counted where they are before they meet."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("group_size"))


def _enter(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The batch's texts that no other batch has brought, (digest, doc_id), after they are in the index."""
    new = saved(index.unseen(_groups(rows).select("digest", "doc_id"), batch), "new")
    index.append(new, batch)
    return new


def _report(rows: DataFrame, new: DataFrame, index: DigestIndex) -> DataFrame:
    brought = new.select("digest", F.lit(True).alias("brought"))
    winners = index.table().select("digest", F.col("doc_id").alias("keep_id"))
    groups = saved(_groups(rows).select("digest", "group_size").join(winners, "digest").join(brought, "digest", "left"), "groups")
    kept = F.col("brought").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return spread_join(rows, groups, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def dedup_against(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept; the index gains the batch's new texts.

    Reads doc_id and text. keep_id is the index's winner for the text, group_size counts the batch's rows
    with that text, kept marks rows of this batch that stay: those whose doc_id is keep_id where the batch
    brought the text. Repeated rows with the winning doc_id are all marked. Null doc_ids lose to any other.
    batch: its name, which a repeated run must give again; without one it is new each time.
    """
    rows = _digests(docs)
    return _report(rows, _enter(rows, index, batch or uuid.uuid4().hex), index)


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 2, table: str | None = None) -> DataFrame:
    """As dedup_against, for a whole table that goes through the index in batches; group_size counts the table's rows.

    table: the table's name, which its batches carry in the index, so that another table's entries are not taken for its own; a
    repeated run must give the same, and without one it is new each time.
    The batches are ranges of doc_id, the highest first and null doc_ids with the lowest, so the largest doc_id
    of a text wins over all batches too.
    """
    rows, table = _digests(docs), table or uuid.uuid4().hex
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)])).first()[0] or []
    new, below = [], F.lit(True)
    for k, cut in enumerate([*dict.fromkeys(cuts), None]):
        own = F.lit(True) if cut is None else F.coalesce(F.col("doc_id") > cut, F.lit(False))
        new.append(_enter(rows.where(below & own), index, f"{table}/range-{k}"))
        below = below & ~own
    return _report(rows, reduce(DataFrame.union, new), index)


def drop_duplicates(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, one a text, with their columns; texts another batch brought to the index go. See dedup_against."""
    known = _digests(docs.select("doc_id", "text"))
    new = _enter(known, index, batch or uuid.uuid4().hex)
    seen = known.join(new.select("digest"), "digest", "left_anti").select("digest").distinct()
    if not seen.isEmpty():
        gone = saved(seen, "seen")
        docs = docs.join(gone.withColumnRenamed("digest", "seen_digest"), digest(docs["text"]) == F.col("seen_digest"), "left_anti")
    return keep_first(docs, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), digest(F.col("text")).alias("root")), largest=True)
