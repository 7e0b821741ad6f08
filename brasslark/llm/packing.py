"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents longer than a bin are cut: full pieces are bins of their own, the last piece is packed. Pieces are
dealt by hash into shards of about SHARD pieces, so the work has no order that spans the cluster and a hot
source or group of copies is spread over all shards. In a shard, pieces go in from the largest to the
smallest. The open bins stand in order of their residual and carry bitmaps of the sources and duplicate
clusters they hold. The search starts at the first bin that is large enough and goes on to its successors
until a compatible one is found, which is the tightest; if there is none, a new bin is opened.

A bin holds no two pieces of one duplicate cluster, and at most `per_source` pieces of one source: plane k of
the source bitmap has the sources that have over k pieces, so the last plane says which sources are full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import saved, word_count

CAPACITY = 2048
#: Pieces in a shard, on average.
SHARD = 4096


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece (size, source, cluster), in the order given; source and cluster number bits, -1 is none."""
    bins: list[tuple[int, int]] = []  # (residual, bin), in order
    planes: list[list[int]] = []  # of each bin, the source bitmaps
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (planes[bins[at][1]][-1] & s or clusters[bins[at][1]] & c):
            at += 1
        if at < len(bins):
            residual, k = bins.pop(at)
        else:
            residual, k = capacity, len(planes)
            planes.append([0] * per_source)
            clusters.append(0)
        for p, plane in enumerate(planes[k]):
            if not plane & s:
                planes[k][p] |= s
                break
        clusters[k] |= c
        insort(bins, (residual - size, k))
        out.append(k)
    return out


def _full_name(*parts: str) -> Column:
    return F.concat_ws("-", F.lit("full"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parts])


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = 2, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, n_words, bin_id, bin_words: where each piece of each row of docs lies.

    Reads doc_id, text and source. A piece is words start to start + n_words of the text. Rows without words
    have one piece of 0 words and no bin (null). Equal texts are one duplicate cluster; a null source is a
    source of its own; repeated rows are separate rows, which never share a bin. bin_words: words in the bin.
    Rows alike are counted, numbered, and dealt by that number, so they do not gather in one shard whatever their
    ids; the same rows are packed and named in the same way in every run.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("cluster"))
    rows = rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("deal", F.xxhash64("doc_id", "source", "cluster", "copy"))
    rows = saved(rows.drop("n"), "sizes")
    n = rows.where(F.col("size") % capacity > 0).count()
    shards = max(1, -(-n // shard))

    long = lambda x: F.lit(x).cast("long")
    full = rows.where(F.col("size") >= capacity).withColumn("piece", F.explode(F.sequence(long(0), F.floor(F.col("size") / capacity) - 1)))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), long(capacity).alias("n_words"), _full_name("doc_id", "source", "cluster", "copy", "piece").alias("bin_id"), long(capacity).alias("bin_words"))
    none = rows.where("size = 0").select("doc_id", long(0).alias("piece"), long(0).alias("start"), long(0).alias("n_words"), F.lit(None).cast("string").alias("bin_id"), long(None).alias("bin_words"))

    def run(table: pa.Table) -> pa.Table:
        """One shard. Ids stay in Arrow, where a null leaves the other longs whole."""
        table = table.sort_by([("n_words", "descending"), ("deal", "ascending")])
        source, cluster = (pc.fill_null(table.column(c).dictionary_encode(null_encoding="encode").combine_chunks().indices, 0).to_numpy() for c in ("source", "cluster"))
        repeated = np.bincount(cluster)[cluster] > 1 if len(cluster) else np.zeros(0, bool)
        cluster = np.where(repeated, np.cumsum(np.bincount(cluster) > 1)[cluster] - 1, -1)  # -1 for those alone in the shard
        sizes = table.column("n_words").to_numpy()
        k = np.array(best_fit(zip(sizes.tolist(), source.tolist(), cluster.tolist(), strict=True), capacity, per_source))
        words = np.bincount(k, sizes).astype(np.int64)[k]
        own = table.column("shard")[0].as_py()
        out = [*(table.column(c) for c in ("doc_id", "piece", "start", "n_words")), pa.array([f"{own}-{b}" for b in k.tolist()]), pa.array(words)]
        return pa.Table.from_arrays(out, ["doc_id", "piece", "start", "n_words", "bin_id", "bin_words"])

    whole = F.floor(F.col("size") / capacity).cast("long")
    tails = rows.where(F.col("size") % capacity > 0).select("doc_id", "source", "cluster", "deal", whole.alias("piece"), (whole * capacity).alias("start"), (F.col("size") % capacity).cast("long").alias("n_words"), F.pmod("deal", F.lit(shards)).alias("shard"))
    packed = tails.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece long, start long, n_words long, bin_id string, bin_words long")
    return packed.union(full).union(none)
