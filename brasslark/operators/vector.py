"""Exact vector search: every vector is scored, filters come first.

Vectors and queries meet in cells of at most VECTORS by QUERIES rows on the average, and each cell keeps the k best of each of its queries.
A matrix product finds which can be among them; their scores are then summed number by number as SQL does, so they and their ties do not
depend on cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from brasslark.sources.scratch import saved

#: Rows of a cell's sides, and queries that are multiplied at once; they bear on speed only.
VECTORS, QUERIES, AT_ONCE = 16384, 8192, 128
#: More than products of a cell can be off by rounding.
SLACK = 1e-9


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first number to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i] * b[..., i]
    return out


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, length: int) -> np.ndarray:
    return pc.list_flatten(column.take(pa.array(rows))).to_numpy().reshape(-1, length)


def _nearest(k: int, key: str, keep: tuple[str, ...], unscored: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best vectors of each query of a cell."""

    def best(x: np.ndarray, v: np.ndarray, q: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per query: places of the best vectors, their scores, and which scores are none."""
        out, w = [], np.sqrt(_dot(q, q))
        for at in range(0, len(q), AT_ONCE):
            lengths = w[at : at + AT_ONCE, None] * v[None, :]
            rough = q[at : at + AT_ONCE] @ x.T / lengths
            rough[np.isnan(rough)] = np.inf  # NaN is the largest number
            rough[lengths == 0] = -np.inf
            least = np.partition(rough, -k, axis=1)[:, -k] - SLACK if len(x) > k else np.full(len(rough), -np.inf)
            for i, row in enumerate(rough):
                found = np.flatnonzero(row >= least[i])
                both = v[found] * w[at + i]
                score, no = _dot(x[found], q[at + i]) / both, both == 0
                order = np.lexsort((ranks[found], -np.where(no, -np.inf, np.where(np.isnan(score), np.inf, score))))[:k]
                out.append((found[order], score[order], no[order]))
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        ranks = np.empty(n, np.int64)
        ranks[pc.sort_indices(left.column(key), null_placement="at_start").to_numpy()] = np.arange(n)
        size, asked = (pc.fill_null(pc.list_value_length(t.column(c)), 0).to_numpy() for t, c in ((left, "embedding"), (right, "query")))
        at, of, scores, none = [], [], [], []
        with np.errstate(all="ignore"):
            for length in np.unique(asked):
                rows, own = np.flatnonzero(size == length) if length else np.empty(0, np.int64), np.flatnonzero(asked == length)
                found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, bool))] * len(own)
                if len(rows):
                    x = _matrix(left.column("embedding"), rows, length)
                    found = best(x, np.sqrt(_dot(x, x)), _matrix(right.column("query"), own, length), ranks[rows])
                for query, (places, score, no) in zip(own, found, strict=True):
                    places = rows[places]
                    if not unscored:
                        places, score, no = places[~no], score[~no], no[~no]
                    elif no.any() or len(places) < min(k, n):  # those without a score come last, by key
                        places, score = places[~no], score[~no]
                        rest = np.setdiff1d(np.arange(n), places)
                        rest = rest[np.argsort(ranks[rest])][: k - len(places)]
                        places, no = np.concatenate((places, rest)), np.arange(len(places) + len(rest)) >= len(places)
                        score = np.concatenate((score, np.zeros(len(rest))))
                    at.append(places)
                    of.append(np.full(len(places), query))
                    scores.append(score)
                    none.append(no)
        if not at:
            at, of, scores, none = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, bool)]
        some, told = left.take(pa.array(np.concatenate(at))), right.column("query_id").take(pa.array(np.concatenate(of)))
        return pa.table([told, *(some.column(c) for c in (key, *keep)), pa.array(np.concatenate(scores), pa.float64(), mask=np.concatenate(none))], ["query_id", key, *keep, "score"])

    return run


def _largest(rows: DataFrame, on: list[str]) -> int:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def hits(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", keep: tuple[str, ...] = (), on: tuple[tuple[Column, Column], ...] = (), unscored: bool = False) -> DataFrame:
    """query_id, key, keep, score (the cosine), place: the k nearest vectors (embedding) of each query (query_id, query), ties by key.

    A query is held against the vectors that agree with it in each pair of on, an expression over vectors and one over queries. A score
    is NULL if either side has no length, or their dimensions differ; with unscored such rows come last, else not at all.
    """
    names = [f"_on{i}" for i in range(len(on))]
    numbers = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>")).alias(c)
    left = vectors.select(key, *keep, numbers("embedding"), *[a.alias(n) for n, (a, _) in zip(names, on, strict=True)]).na.drop(subset=names)
    right = query.select("query_id", numbers("query"), *[b.alias(n) for n, (_, b) in zip(names, on, strict=True)]).na.drop(subset=names)
    if on:
        left = left.join(right.select(*names).distinct(), names, "left_semi")
    across, down = (max(1, -(-_largest(rows, names) // size)) for rows, size in ((left, VECTORS), (right, QUERIES)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = [*names, "_v", "_q"]
    left = left.withColumn("_v", part(key, across)).withColumn("_q", copies(down))
    right = right.withColumn("_q", part("query_id", down)).withColumn("_v", copies(across))
    schema = StructType([query.schema["query_id"], *(vectors.schema[c] for c in (key, *keep))]).add("score", DoubleType())
    rows = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(_nearest(k, key, keep, unscored), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, key, keep, score, place: the k nearest vectors of each query (query_id, query), ties by key; see hits."""
    return hits(vectors, query, k, key, keep)


#: What the tiers of `relaxed` drop.
DROPPED = ("none", "years", "years and items")


def relaxed(vectors: DataFrame, query: DataFrame, tiers: list[tuple[Column, tuple[tuple[Column, Column], ...]]], k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, score, place, relaxed: the k best hits of the first tier of filters that has any; `relaxed` names what was dropped.

    Each tier is a filter of vectors and pairs of expressions that must agree (see hits), and is asked only by the queries that the
    tiers before it leave without a hit.
    """
    out, left = None, query
    for i, (filtered, on) in enumerate(tiers):
        found = hits(vectors.where(filtered), left, k, key, on=on, unscored=True).withColumn("relaxed", F.lit(DROPPED[i]))
        found = saved(found, "hits")
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return out


def indexed(chunks: DataFrame) -> DataFrame:
    """ticker, chunks, newest fiscal year."""
    return chunks.groupBy("ticker").agg(F.count(F.lit(1)).alias("chunks"), F.max("fiscal_year").alias("newest"))
