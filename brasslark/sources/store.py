"""Stored tables as Parquet folders: partitioned, replaced partition by partition, checked after a write."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def ensure(self, name: str, schema: str, *partition: str) -> DataFrame:
        """The table, made empty if it is not there; an existing one is left as it is."""
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.partitionBy(*partition).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path(name))

    def append(self, name: str, rows: DataFrame, *partition: str) -> None:
        rows.write.mode("append").partitionBy(*partition).parquet(self.path(name))

    def replace_partitions(self, name: str, rows: DataFrame, *partition: str) -> None:
        """Only the partitions that rows has are replaced: an ingest of a company again leaves no row of the old one."""
        rows.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(self.path(name))


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows, and how many there are (`n`) and meet each condition, counted by whatever writes or reads them: no second scan."""
    counts = Observation()
    return rows.observe(counts, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()]), counts


class KeyedTable:
    """A table partitioned by one column and bucketed and sorted by a key, so that lookups by key, joins and windows on it need no shuffle and a year's rows are read alone.

    Tables of the same key and number of buckets meet without a shuffle too. One writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, key: str, buckets: int = 16):
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets

    def write(self, rows: DataFrame, partition: str | None = None, order: tuple[str, ...] = ()) -> KeyedTable:
        """Replaces the table; one file a bucket (and partition). rows may not come from the table itself."""
        dealt = rows.repartition(self.buckets, self.key).sortWithinPartitions(*([partition] if partition else []), self.key, *order)
        writer = dealt.write.mode("overwrite").format("parquet").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key, *order)
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: a writer asserts that there are none. NULL keys are not constrained."""
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """chunks with an embedding from a plug-in that takes a list of texts; it runs in the tasks, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embed([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in chunks.dtypes), "embedding array<float>"]))


def local_filings(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, html and the side-car fields of every page in a folder; a page without a side-car has NULLs."""
    pages = spark.read.text(f"{folder.rstrip('/')}/*.htm*", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html?$", 1).alias("doc_id"), F.col("value").alias("html"))
    meta = "ticker string, company_name string, cik string, form string, filing_date string, period_end string, accession string"
    cars = spark.read.schema(meta).option("multiLine", True).json(f"{folder.rstrip('/')}/*.json").withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.meta)?\.json$", 1))
    return pages.join(cars, "doc_id", "left")
