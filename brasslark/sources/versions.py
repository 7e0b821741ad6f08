"""Tables in versions: a change is written aside, and a small manifest that is made last says which files are the table.

A table is cut by a hash of its key into a fixed number of buckets, each in a folder of its own. A merge reads and writes only the
buckets that its rows fall into; the manifest of the new version takes the other buckets over. So a table may be changed by
rows that come from itself, readers see a version whole or not at all, a lost write leaves the old version, and a batch
that comes twice is a version once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class Manifest(NamedTuple):
    """version; folders: of each bucket that has rows; batches: the last batch of each writer."""

    version: int
    folders: dict[str, str]
    batches: dict[str, int]


class Conflict(RuntimeError):
    """Another writer made the version first."""


class VersionedTable:
    """schema: DDL; key: the columns that tell rows apart; buckets: chosen once, enough that one fits a few tasks."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int):
        return self._at(f"{self.path}/_versions/{version:012}.json")

    def latest(self) -> Manifest:
        folder = self._at(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return Manifest(0, {}, {})
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        versions = [int(n[:12]) for n in names if n.endswith(".json")]
        return self.manifest(max(versions)) if versions else Manifest(0, {}, {})

    def manifest(self, version: int) -> Manifest:
        text = self.spark.read.text(self._manifest_path(version).toString(), wholetext=True).first()["value"]
        return Manifest(**json.loads(text))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one."""
        return self._rows((self.latest() if version is None else self.manifest(version)).folders.values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def change(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch: int | None = None) -> Manifest:
        """A version in which `how(old, rows)` stands for the old rows of all buckets that rows fall into; keys may not change buckets.

        A batch of a writer with a number that is not above the writer's last one changes nothing.
        """
        now = self.latest()
        if batch is not None and batch <= now.batches.get(writer, -1):
            return now
        rows = rows.persist()
        try:
            touched = [str(r[0]) for r in self._dealt(rows).select(_BUCKET).distinct().collect()]  # at most as many as there are buckets
            old = self._rows([now.folders[b] for b in touched if b in now.folders])
            folder = f"data-{uuid.uuid4().hex}"
            self._dealt(how(old, rows)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *self.key).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        finally:
            rows.unpersist()
        written = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._at(f"{self.path}/{folder}")) if "=" in f.getPath().getName()}
        folders = {b: f for b, f in now.folders.items() if b not in touched} | {b: f"{folder}/{_BUCKET}={b}" for b in written}
        batches = now.batches | ({writer: batch} if batch is not None else {})
        return self._publish(Manifest(now.version + 1, folders, batches))

    def _publish(self, m: Manifest) -> Manifest:
        """The manifest is written aside and renamed, which fails if the version is there."""
        target, aside = self._manifest_path(m.version), self._at(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, True)
        out.write(json.dumps(m._asdict()).encode())
        out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {m.version} of {self.path} is there already")
        return m

    def upsert(self, rows: DataFrame, order: list | None = None, **batch) -> Manifest:
        """Rows stand for those of the same key; of several with one key the first in `order` (columns) counts."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            from brasslark.operators.windows import latest

            one = latest(new, self.key, order) if order else new.dropDuplicates(self.key)
            return old.join(one.select(*self.key), self.key, "left_anti").unionByName(one.select(*old.columns))

        return self.change(rows, how, **batch)

    def sink(self, writer: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch is a version, once, however often it is sent."""

        def put(rows: DataFrame, batch: int) -> None:
            self.change(rows, how, writer, batch)

        return put

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests but the last `keep` and the data folders that none of these names; gives how many folders went. No reader may be on an older version."""
        last = self.latest().version
        if not last:
            return 0
        kept = range(max(1, last - keep + 1), last + 1)
        used = {f.split("/")[0] for v in kept for f in self.manifest(v).folders.values()}
        gone = 0
        for f in self._fs.listStatus(self._at(self.path)):
            name = f.getPath().getName()
            if name.startswith("data-") and name not in used:
                gone += bool(self._fs.delete(f.getPath(), True))
        for v in range(1, kept[0]):
            self._fs.delete(self._manifest_path(v), False)
        return gone
