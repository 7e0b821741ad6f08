"""Order MinHash fingerprints (Marcais et al., 2019), sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so that repeats count. For each of ROWS hash
functions the TUPLE k-mers with the smallest hashes are selected, put back in the order they have in the
text, and the tuple is hashed to one place of the signature. Two texts agree in a place about as often as
they have those k-mers in common and in the same order; likeness is the share of places that agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasslark.llm.common import saved

K = 8
TUPLE = 2
ROWS = 64
SEED = 9
#: k-mers of a text up to which all hash functions are applied at once.
AT_ONCE = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@cache
def functions(rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of the hash functions, which permute 32-bit words: narrow enough for vector instructions."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, rows, np.uint32) | np.uint32(1), rng.integers(0, 2**32, rows, np.uint32)


def numbered_kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """One 64-bit word for each k-mer and the number of its occurrence; a shorter text is one k-mer, an empty one none."""
    if not len(codes):
        return np.empty(0, np.uint64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _BASE + codes[i : i + n]
    h = mixed(h + np.uint64(k))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    starts = np.flatnonzero(first)
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - starts[np.cumsum(first) - 1]).astype(np.uint64)
    return mixed(h + nth * _MIX)


def signature(text: str, k: int = K, size: int = TUPLE, rows: int = ROWS) -> np.ndarray:
    """The signature as 16-bit words."""
    return signature_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), k, size, rows)


def signature_of(codes: np.ndarray, k: int = K, size: int = TUPLE, rows: int = ROWS) -> np.ndarray:
    words = numbered_kmers(codes, k)
    a, b = functions(rows)
    n = len(words)
    if n <= size:  # all k-mers, in order
        chosen = np.broadcast_to(words, (rows, n))
    else:
        short = (words >> np.uint64(32)).astype(np.uint32)
        places = np.empty((rows, size), np.int64)
        step = max(1, AT_ONCE // n)
        for at in range(0, rows, step):
            h = (short[None, :] ^ b[at : at + step, None]) * a[at : at + step, None]
            for j in range(size):
                least = h.argmin(1)
                places[at : at + step, j] = least
                h[np.arange(len(h)), least] = 0xFFFFFFFF
        chosen = words[np.sort(places, 1)]
    out = mixed(a.astype(np.uint64) + np.uint64(n == 0))
    for j in range(chosen.shape[1]):
        out = mixed(out + chosen[:, j])
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 4
    return np.concatenate((text[: len(text) - cut], following[:cut]))


def fingerprint(docs: DataFrame, k: int = K, size: int = TUPLE, rows: int = ROWS) -> DataFrame:
    """doc_id, fingerprint per row of docs (doc_id, text); a null text counts as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [text_of(signature(t or "", k, size, rows)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: np.ndarray, own: np.ndarray, following: np.ndarray, next_own: np.ndarray) -> dict:
    import hashlib

    new = edited(text, following)
    changed = signature_of(new.astype(np.uint64))
    sha = hashlib.sha256(new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha, "fingerprint": text_of(own), "edited_fingerprint": text_of(changed), "near_edited": likeness(own, changed), "near_next": likeness(own, next_own)}


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text, and how like its own are that one and the next document's.

    Reads doc_id and text. The next document is that of the next doc_id (after the last: the first); rows with
    one doc_id stand in order of their texts, null doc_ids first. A lone row is its own next. Texts cross the
    network once, dealt by ranges of doc_id; a task compares its rows with their successors as it reads them.
    Only each range's last row has its successor in another task: those rows, two texts a task, are paired by
    a join afterwards.
    """
    spark = docs.sparkSession
    fields = f"{SCHEMA}, part int, edge string, text string"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, n = TaskContext.get().partitionId(), None, 0

        def batch(rows: list[dict]) -> pa.RecordBatch:
            whole = [{"part": part, **r} for r in rows]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in whole], t) for c, t in zip(names, kinds, strict=True)], names)

        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                codes = code_points(text)
                own = signature_of(codes.astype(np.uint64))
                if before is None:
                    out.append({"edge": "first", "text": text or ""})
                else:
                    out.append(compared(*before, codes, own))
                before = (doc_id, codes, own)
            yield batch(out)
        if before is not None:
            yield batch([{"doc_id": before[0], "edge": "last", "text": before[1].tobytes().decode("utf-32-le", "surrogatepass")}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = saved(rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, fields), "fingerprints")

    # One row of numbers a task, to find the next range that has rows.
    first = done.where("edge = 'first'").select("part", F.col("text").alias("next_text"))
    order = first.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    order = order.crossJoin(F.broadcast(first.agg(F.min("part").alias("start")))).select("part", F.coalesce("next", "start").alias("next"))
    last = done.where("edge = 'last'").select("doc_id", "text", "part").join(order, "part")
    pairs = last.join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                text, following = code_points(r["text"]), code_points(r["next_text"])
                own, next_own = (signature_of(x.astype(np.uint64)) for x in (text, following))
                out.append(compared(r["doc_id"], text, own, following, next_own))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, kinds, strict=False)], names[:7])

    return done.where("edge is null").select(*names[:7]).union(pairs.mapInArrow(edges, SCHEMA))
