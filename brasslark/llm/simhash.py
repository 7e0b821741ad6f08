"""SimHash fingerprints and their near-duplicate groups through pivot distance tables.

Two fingerprints that differ in at most 3 bits agree on at least two of five blocks of bits, so candidates
meet in groups that share two blocks. Inside a group no pair is taken for granted: the Hamming distances of
every fingerprint to many reference fingerprints (the pivots) are tabulated first. By the triangle
inequality a link's distances to each pivot differ by 3 at most; the sorted first column cuts the
candidates to a window, the largest difference over all columns discards most of the rest, and the Hamming
distance itself verifies the survivors. Only a spanning forest of a group's links leaves it, since groups
of documents are all that is asked for.

Groups over LIMIT fingerprints are split again on the bits that are still free, by the same pigeonhole
argument, three levels deep; what is left then holds 2**14 fingerprints at most. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasslark.llm.common import SALTS, discard, keep_first, salted, saved, spread_join

BITS = 64
SEED = 42
#: Most differing bits of a link, and blocks into which free bits are cut (BLOCKS - RADIUS of them agree).
RADIUS = 3
BLOCKS = 5
#: Fingerprints in a group beyond which it is split again.
LIMIT = 2048
#: Reference fingerprints of the distance tables.
PIVOTS = 24
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text: a bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, fp) per row of docs; fp is the fingerprint as a signed long, key the text's hash. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), words)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(free: int) -> list[int]:
    """The masks of all pairs of agreeing blocks, where the free bits are cut into BLOCKS blocks."""
    bits = [i for i in range(BITS) if free >> i & 1]
    blocks = [sum(1 << i for i in part.tolist()) for part in np.array_split(bits, BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - RADIUS)]


def pivots() -> np.ndarray:
    """PIVOTS fixed reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all of a group's linked fingerprints; table has the distances to each pivot (row by row)."""
    order = np.argsort(table[:, 0], kind="stable")
    left, links = order, []
    first = table[left, 0].astype(np.int16)
    while len(left) > 1:
        found = [int(left[0])]
        left, first = left[1:], first[1:]
        while found and len(left):
            v = found.pop()
            at = int(table[v, 0])
            lo, hi = np.searchsorted(first, (at - RADIUS, at + RADIUS + 1))
            near = left[lo:hi]
            hits = np.flatnonzero(np.abs(table[near].astype(np.int16) - table[v].astype(np.int16)).max(axis=1, initial=0) <= RADIUS)
            hits = hits[np.bitwise_count(fps[near[hits]] ^ fps[v]) <= RADIUS]
            if len(hits):
                linked = near[hits].tolist()
                links += [(v, w) for w in linked]
                found += linked
                keep = np.ones(len(left), bool)
                keep[lo + hits] = False
                left, first = left[keep], first[keep]
    return links


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside groups; rows (mask, part, fp) come with each group's rows together, over batches if need be."""
    refs = pivots()

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
        table = np.bitwise_count(fps[:, None] ^ refs[None, :])
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        close = np.abs(table[two].astype(np.int16) - table[two + 1]).max(axis=1, initial=0) <= RADIUS
        two = two[close]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS]
        a, b = [fps[two]], [fps[two + 1]]
        for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = forest(fps[s : s + n], table[s : s + n])
            if own:
                pairs = np.array(own) + s
                a.append(fps[pairs[:, 0]])
                b.append(fps[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    keys, fps = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, np.stack([batch.column(c).to_numpy() for c in ("mask", "part")], 1)))
        fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        if len(change):
            end = int(change[-1]) + 1
            yield links(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
    if len(fps):
        yield links(keys, fps)


def near_links(spark: SparkSession, fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links of at most RADIUS bits between the distinct fingerprints (column fp) that join all linked ones."""
    everything = (1 << BITS) - 1
    first = block_masks(everything)
    second = [(m, m | x) for m in first for x in block_masks(everything & ~m)]
    third = [(m, m | x) for m in dict.fromkeys(m for _, m in second) for x in block_masks(everything & ~m)]

    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in first])).alias("mask"))
    found = []
    for masks in (second, third, None):
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        # sizes are counted before the rows meet, and written: few groups have more than one row, and what is finer is planned only where it is needed
        sizes = saved(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        fit = sizes if masks is None else sizes.where(F.col("n") <= limit)
        whole = rows.join(fit.select("mask", "part"), ["mask", "part"]).select("mask", "part", "fp").repartition("mask", "part")  # the join may have split a group over tasks
        found.append(whole.sortWithinPartitions("mask", "part").mapInArrow(group_links, "a long, b long"))
        large = sizes.where(F.col("n") > limit).select("mask", "part")
        if masks is None or large.isEmpty():
            break
        large = saved(rows.join(large, ["mask", "part"]).select("mask", "fp"), "large")
        finer = spark.createDataFrame([(signed(a), signed(b)) for a, b in masks], "mask long, finer long")  # 100 or at most 1000 rows, whatever the data
        rows = large.join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), "fp")
    return reduce(DataFrame.union, found).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(node, root): for every node with a link, the smallest node it reaches. Alternating large and small stars.

    Each star writes its links to the shared folder, so lineage and plans stay short and no link passes the driver.
    """
    def state(e: DataFrame) -> tuple:
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")  # the root of a large component is the end of all its links
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    now = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = saved(spread_join(both.withColumn("salt", salt), least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large.withColumn("salt", salt), least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        last, edges = edges, saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(last, large)
        before, now = now, state(edges)
        if now == before:
            break
    top = edges.groupBy("u").agg(F.min("v").alias("root"))
    return top.select(F.col("u").alias("node"), "root").union(top.select(F.col("root").alias("node"), "root").distinct())  # no link ends a root's own row


def near_groups(docs: DataFrame, words: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, key, fp, root, component_id) per row of docs; root names the group, component_id is the smallest doc_id reachable over links.

    Reads doc_id and text. Null and empty texts have fingerprint zero and link like any other; a group whose
    doc_ids are all null has a null component_id; repeated rows are one fingerprint; an empty table gives none.
    """
    rows = salted(fingerprints(docs, words), "fingerprints")
    each = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    found = saved(roots(near_links(docs.sparkSession, each.select("fp"), limit)), "roots")
    linked = each.join(found, each["fp"] == found["node"])
    tops = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    spread = linked.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = spread_join(spread, tops, "root").select("fp", "root", "component_id")
    copies = each.where("n > 1").join(found, each["fp"] == found["node"], "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    groups = saved(groups.unionByName(copies), "groups").withColumn("grouped", F.lit(True))
    own = F.coalesce("grouped", F.lit(False))  # a fingerprint that is neither linked nor repeated is its own group
    out = spread_join(rows, groups, "fp", how="left")
    return out.select("doc_id", "key", "fp", F.when(own, F.col("root")).otherwise(F.col("fp")).alias("root"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one a group: the row of the group's smallest doc_id, with its columns. See near_groups."""
    return keep_first(docs, near_groups(docs, **options))
