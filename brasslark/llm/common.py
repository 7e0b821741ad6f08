"""What the operators of this subpackage share: reading, scratch tables, words, splits."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir of the session. Where it is unset, local mode gets a folder of its own; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="brasslark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/brasslark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, and gives the planner a real size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `saved` wrote, once nothing reads them any more; the others go when the driver ends."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("brasslark-"):
                folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Parts into which the rows of one hot key are dealt where they meet a small side.
SALTS = 16


def salted(df: DataFrame, name: str) -> DataFrame:
    """df saved with a column `salt` that deals rows evenly, whatever their values; repeated and null ids don't gather in one part."""
    return saved(df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), name)


def spread_join(rows: DataFrame, few: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows (with a column salt) joined with few, which has one row a key: each hot key of rows is SALTS keys."""
    return rows.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how).drop("salt")


#: Bits of a sieve. Its table has at most this many by 64 rows, whatever the keys are.
SIEVE = 1 << 22


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(slot, mask): a bitmap of hashed keys (longs) of fixed size, for `sifted`."""
    bucket = F.expr(f"pmod(`{key}`, {SIEVE}L)")
    rows = keys.select((bucket / 64).cast("long").alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64L) as int))").alias("bit"))
    return rows.groupBy("slot").agg(F.bit_or("bit").alias("mask"))


def sifted(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The rows whose key is in a sieve, and a few others; a join on the key decides. The sieve is small at any size, so it is broadcast."""
    hit = F.expr(f"shiftright(mask, cast(pmod(`{key}`, 64L) as int)) & 1L") == 1
    met = rows.join(F.broadcast(table), F.expr(f"cast(pmod(`{key}`, {SIEVE}L) / 64 as long)") == F.col("slot"))
    return met.where(hit).drop("slot", "mask")


def keep_first(docs: DataFrame, groups: DataFrame, largest: bool = False) -> DataFrame:
    """The rows of docs that stay, one a group of groups (doc_id, key, root): the row of the group's smallest (or largest) doc_id, with its columns.

    key is the text's xxhash64; null doc_ids lose to all others. Only rows that go, and repeated ones, are looked
    up; where these are few, texts do not cross the network, and otherwise they do once.
    """
    doc, key, own, stays = fresh(docs, "first_doc", "first_key", "first_own", "first_stays")
    each = salted(groups.groupBy("doc_id", "key", "root").agg(F.count(F.lit(1)).alias("n")), "each")
    this = F.struct(F.col("doc_id").isNull() != F.lit(largest), F.col("doc_id"), F.col("key"))
    first = each.groupBy("root").agg((F.max(this) if largest else F.min(this)).alias("w"), F.count(F.lit(1)).alias("m"), F.max("n").alias("k")).where("m > 1 or k > 1")
    marked = spread_join(each, first, "root").select(F.col("doc_id").alias(doc), F.col("key").alias(key), (this == F.col("w")).alias(stays), "n")
    marked = saved(marked.where(~F.col(stays) | (F.col("n") > 1)).drop("n"), "marked")
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(marked, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    out = rows.where(F.col(stays).isNull())
    if not marked.where(stays).isEmpty():
        out = out.union(rows.where(stays).dropDuplicates([doc, key]))
    return out.drop(doc, key, own, stays)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given which df does not have yet (Spark resolves names without regard to case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


#: Rows of a batch, where rows have whole texts.
BATCH = 256


def small_batches(spark: SparkSession) -> dict[str, str]:
    """From now on Parquet's reader and Arrow take at most BATCH rows at once in this session. Returns the settings as they were.

    With long texts the usual batches (4096 and 10 000 rows) are tens of MB a task, in pieces so large that an executor's heap grows for
    them, once more outside the heap and once more in Python; and what a process has touched it keeps.
    """
    names = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {name: spark.conf.get(name) for name in names}
    for name, rows in before.items():
        if not 0 < int(rows) <= BATCH:  # 0 is no limit
            spark.conf.set(name, str(BATCH))
    return before


#: Bytes of an Arrow batch that goes to Python, where rows are of any size.
BATCH_BYTES = 1 << 22


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Parquet's reader takes at most BATCH rows at once, and Arrow BATCH_BYTES, so rows may be many and short or few and long."""
    limits = {"spark.sql.parquet.columnarReaderBatchSize": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, most in limits.items():
            spark.conf.set(name, str(most))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def given_back() -> None:
    """Gives the memory that Python and Arrow no longer use back to the system (with glibc); a worker lives on after its task, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def hash_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """About `limit` of the rows, the same in every run: those whose hash of the keys is under limit / rows. All if there are fewer."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(limit / n * (1 << 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, limit: int) -> DataFrame:
    """(doc_id, text, label) of about `limit` labelled documents outside the held-out part (all if there are fewer).

    Only these ids are broadcast. A document with several labels takes the largest one, one with several rows
    gives several; rows without doc_id or label are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(~held_out(F.col("doc_id"), parts, part))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = hash_sample(saved(known, "labels"), limit, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
