"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The documents
of a source stand in one order; the running sum of expected copies, shifted by one random offset of the
source, crosses some integers inside each document's step, and the document is taken once per crossing.
The order is by size, so the words taken stay within about one document of the target.

The running sum needs a document's rank in its source. A source may hold a third of all rows, so the rank
is put together from counts: sizes within the source, then hash prefixes within the size, then rows within
the prefix. No window ever sees more than a source's distinct sizes, 4096 prefixes, or one prefix's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.llm.common import fresh, saved, word_count

#: Hex digits of the hash that split one size of one source into parts.
PREFIX_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take the weights in turn. The targets share `share` times all
    sizes by weight; a target above `cap` times its source's size stops there and the excess is shared
    again among the others until none is above. Sources are numbered over ranges, so they may be as many as hosts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = F.col("source").asc_nulls_last()
    per = saved(per.repartitionByRange(in_order).withColumn("part", F.spark_partition_id()), "ordered")
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    ranges = per.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", earlier.alias("earlier"))
    per = per.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(in_order))).join(ranges, "part")
    place = F.col("earlier") + F.col("nth") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = saved(per.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.lit(float(cap)) * F.col("source_size")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round caps at least one more source, or ends
        above = limit < F.lit(level) * F.col("weight")
        full, left = per.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (total - full) / left if left else float("inf")
        if new <= level:
            break
        level = new
    target = F.least(limit, F.lit(level) * F.col("weight")) if level != float("inf") else limit
    return per.select("source", "source_size", target.alias("target"))


def _taken(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: str) -> DataFrame:
    """doc_id, key, source, size, n, source_size, target, rate, first: one row per n rows alike; `first` is the running sum's value before them.

    Alike rows are counted before they meet, so a repeated row is one however often it comes.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), F.col("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("own"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("own")))
    rows = rows.groupBy("doc_id", "key", "source", "size", "own").agg(F.count(F.lit(1)).alias("n"))
    rows = saved(rows.select("doc_id", "key", "source", "size", "n", digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix")), "mix")
    targets = source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)

    parts = rows.groupBy("source", "size", "prefix").agg(F.sum("n").alias("n"))
    sizes = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = lambda keys, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "size", before(["source"], "size").alias("below"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", offset.alias("offset"), rate.alias("rate"))
    sizes = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    parts = parts.select("source", "size", "prefix", before(["source", "size"], "prefix").alias("inside"))
    s = sizes.withColumnRenamed("source", "s_source").withColumnRenamed("size", "s_size")
    parts = parts.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size"))).drop("s_source", "s_size")
    p = parts.withColumnsRenamed({"source": "p_source", "size": "p_size", "prefix": "p_prefix"})

    ranked = rows.withColumn("within", before(["source", "size", "prefix"], "digest", "doc_id", "key"))
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("prefix") == F.col("p_prefix"))
    first = F.col("below") + F.col("inside") + F.col("within")
    return ranked.join(p, on).select("doc_id", "key", "source", "size", "n", "source_size", "target", "rate", "offset", first.alias("first"))


def _crossed(rank: Column) -> Column:
    """Integers that the running sum has crossed after so many rows of the source."""
    return F.floor(F.col("rate") * rank + F.col("offset"))


def mix_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, key, source, size, source_size, target, copies.

    Reads doc_id, text and source; key is the text's hash, for joins back to the rows. A null text has size
    0, a null source is a source of its own, a source without words has target 0 and no copies. Repeated
    rows are separate rows. Ties in size are ordered by the MD5 of doc_id (null: empty), a colon and the text's MD5.
    """
    rows = _taken(docs, weights, share, cap, seed).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rank = F.col("first") + F.col("nth")
    copies = F.least((_crossed(rank) - _crossed(rank - 1)).cast("long"), F.lit(int(-(-cap // 1))))
    return rows.select("doc_id", "key", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns stay the same.

    Rows alike in doc_id and text count as one document here whose copies add up. Only rows that are not
    taken just once are looked up; where these are few, texts do not cross the network, and otherwise they do once.
    """
    doc, key, own, n, again = fresh(docs, "mix_doc", "mix_key", "mix_own", "mix_n", "mix_again")
    taken = _taken(docs, weights, share, cap, seed).withColumn("copies", _crossed(F.col("first") + F.col("n")) - _crossed(F.col("first")))
    taken = taken.groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias(n), (F.sum("n") > 1).alias(again)).where(F.col(again) | (F.col(n) != 1))
    taken = saved(taken.select(F.col("doc_id").alias(doc), F.col("key").alias(key), n, again), "taken")
    rows = docs.withColumn(own, F.xxhash64("text")).join(taken, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    out = rows.where(~F.coalesce(F.col(again), F.lit(False)))
    if not taken.where(again).isEmpty():
        out = out.union(rows.where(again).dropDuplicates([doc, key]))
    out = out.withColumn(n, F.coalesce(n, F.lit(1))).where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(doc, key, own, n, again)
