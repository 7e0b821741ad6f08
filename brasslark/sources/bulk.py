"""Bulk archives as a data source: each task reads a run of a ZIP file's members, and no task unpacks the whole.

    spark.dataSource.register(bulk.ZipMembers)
    spark.read.format("zip_members").option("path", path).option("min_year", 2015).load()

Rows are (member, json, bytes, error): the name without `.json`, the text, its unpacked size, and what kept the member from
being read. Filters on `member` are pushed into the reader, so members that nobody asks for are not unpacked; with min_year,
records of filed facts that end in an earlier year are left out before a text leaves the reader.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "member string, json string, bytes long, error string"
#: Packed bytes of a task's run of members, by default.
RUN = 16 << 20


@contextmanager
def _archive(path: str) -> Iterator[zipfile.ZipFile]:
    """The archive at a path or URI of any store that Arrow reads; only its directory and the members asked for are read."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:/", path) else (pyarrow.fs.LocalFileSystem(), path)
    with store.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
        yield archive


def since(text: str, min_year: int) -> str:
    """Filed facts without the records whose period ends before min_year; anything else in the text stays."""
    data = json.loads(text)
    for tags in (data.get("facts") or {}).values():
        for tag in (tags or {}).values():
            for unit, rows in ((tag or {}).get("units") or {}).items():
                tag["units"][unit] = [r for r in rows or [] if not isinstance(r.get("end"), str) or r["end"][:4] >= f"{min_year:04}"]
    return json.dumps(data, ensure_ascii=False)


@dataclass
class Run(InputPartition):
    members: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], int(options.get("run", RUN))
        self.min_year = int(options["min_year"]) if "min_year" in options else None
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("member",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Run]:
        with _archive(self.path) as archive:
            members = [(i.filename, i.compress_size) for i in archive.infolist() if not i.is_dir()]
        runs, size = [], self.run
        for name, packed in members:
            if self.wanted is not None and _ticker(name) not in self.wanted:
                continue
            if size >= self.run:
                runs.append(Run([]))
                size = 0
            runs[-1].members.append(name)
            size += max(packed, 1)
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.string()), ("json", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
        with _archive(self.path) as archive:
            for name in partition.members:
                text, size, error = None, 0, None
                try:
                    raw = archive.read(name)
                    size, text = len(raw), raw.decode("utf-8") or None
                    if text and self.min_year is not None:
                        text = since(text, self.min_year)
                except (zipfile.BadZipFile, ValueError, AttributeError, NotImplementedError, RuntimeError) as e:
                    text, error = None, str(e)[:200] or type(e).__name__
                yield pa.RecordBatch.from_pydict({"member": [_ticker(name)], "json": [text], "bytes": [size], "error": [error]}, schema)


def _ticker(name: str) -> str:
    return re.sub(r"\.json$", "", name.rsplit("/", 1)[-1])


class ZipMembers(DataSource):
    """Options: path, run (packed bytes a task), min_year."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def members(spark: SparkSession, path: str, min_year: int | None = None, run: int = RUN) -> DataFrame:
    """The members of an archive, one row each."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("path", path).option("run", run)
    return (reader if min_year is None else reader.option("min_year", min_year)).load()


def companies(universe: DataFrame, archive: DataFrame) -> DataFrame:
    """(ticker, json, status) for every company of universe (ticker, cik): ok, missing (no member), empty, or broken.

    Members are named CIK and the ten digits of the company's number.
    """
    named = universe.select("ticker", F.format_string("CIK%010d", F.col("cik").cast("long")).alias("member"))
    j = named.join(archive, "member", "left")
    status = F.when(F.col("bytes").isNull(), "missing").when(F.col("error").isNotNull(), "broken").when(F.col("bytes") == 0, "empty").otherwise("ok")
    return j.select("ticker", "json", status.alias("status"))
