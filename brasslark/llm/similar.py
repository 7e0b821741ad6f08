"""Groups of documents whose sets of word shingles have a Jaccard similarity of SIMILARITY or more, without loss.

This is the SimHash operator for a similarity in place of a radius. No radius of 64 bits holds all pairs of 0.8 and still
tells other documents apart, so there are two fingerprints, and shingle sets decide:

* SimHash fingerprints of the shingles, linked within the radius of `simhash` through its pivot distance tables: what
  is all but the same text.
* Parity fingerprints: bit i tells whether an odd number of the shingles hash to i. Two sets differ in at least as many
  shingles as their fingerprints in bits, so the radius that follows from 0.8 loses nothing. (At that radius distances to
  reference fingerprints hardly ever differ by more, so pairs are compared themselves.) Candidates meet over shingles: in
  any fixed order of all shingles, two sets of 0.8 or more share one among the first n - ceil(0.8 n) + 1 of each. The order
  is by how common the rarest word of a shingle is, so that unrelated texts seldom meet, however many there are.

First every document meets one other of each shared shingle, then others by lot, and at last only pairs of different groups are
looked at, so a large group of near copies is not compared pair by pair. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import SALTS, discard, keep_first, salted, saved, sieve, sifted, small_batches, spread_join
from brasslark.llm.simhash import SEED, near_links, roots, signed

WORDS = 5
#: SIMILARITY as a fraction, so that bounds are exact.
OVER, UNDER = 4, 5
#: Longs of a parity fingerprint.
LONGS = 16
#: Longs to which it is folded where the units of a shingle meet.
FOLDED = 8
#: Times that the units of a shingle meet one of them by lot before pairs are formed; it bears on speed only.
LOTS = 1
#: Binary logarithm of the counters of words, by which rare shingles are told from common ones; it bears on speed only.
COUNTERS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = [f"b{i}" for i in range(LONGS)]


def _words(text: str | None) -> np.ndarray:
    """Hashes of a text's words in their order."""
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def _windows(each: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the word shingles in their order; a shorter text is one shingle, one without words has none."""
    if not len(each):
        return each
    width = min(words, len(each))
    out = np.zeros(len(each) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _ODD + each[i : i + len(out)]
    return (out ^ (out >> np.uint64(32))) * _ODD


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(_windows(_words(text), words))


def _prefix(each: np.ndarray, words: int, commonness: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of the distinct shingles of a text (hashes of its words): by their rarest word, which bounds how often they occur, by all words, by hash.

    A shingle's place depends on its words alone, so it is the same in every text.
    """
    inside = _windows(each, words)
    found, at = np.unique(inside, return_index=True)
    n = len(found)
    if not n:
        return found
    own, width = commonness[_counter(each)], min(words, len(each))
    parts = np.stack([own[at + i] for i in range(width)])
    keep = n - -(-OVER * n // UNDER) + 1
    return found[np.lexsort((found, parts.sum(0, dtype=np.int64), parts.min(0)))[:keep]]


def _counter(each: np.ndarray) -> np.ndarray:
    """The counter of each word."""
    return (each >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _parity(found: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """The parity fingerprint of a set of shingles."""
    bits = np.bincount((found >> np.uint64(7) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _wide(found: np.ndarray) -> np.ndarray:
    """A parity fingerprint of 4 bits a shingle or more, which tells sets of any size apart."""
    return _parity(found, max(1, 1 << (4 * len(found) - 1).bit_length() >> 6))


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two parity fingerprints; the wider one is folded, which leaves a fingerprint of the same set."""
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _simhash(found: np.ndarray) -> int:
    """SimHash over distinct shingles: a bit is set if it is set in over half of them."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return signed(int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _commonness(docs: DataFrame) -> np.ndarray:
    """Eighths of the binary logarithm of how often the words of each counter occur in all documents. There are 2**COUNTERS, whatever the words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.int64)
        for b in _pieces(batches):
            for t in b.column("text"):
                np.add.at(counts, _counter(_words(t.as_py())), 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["counter", "k"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "counter long, k long").groupBy("counter").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(1 << COUNTERS, np.int16)
    out[counts.column("counter").to_numpy()] = 8 * np.log2(counts.column("k").to_numpy())
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row of docs: doc_id, key (the text's hash), unit (the shingle set's), n, fp, prefix, parity fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(_commonness(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            each = [_words(t.as_py()) for t in b.column("text")]
            sets = [np.unique(_windows(w, words)) for w in each]
            units = pa.array([signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64())
            prefix = pa.array([_prefix(w, words, shared.value).view(np.int64) for w in each], pa.list_(pa.int64()))
            bits = np.array([_parity(s) for s in sets], np.uint64).reshape(-1, LONGS)
            own = [b.column("doc_id"), b.column("key"), units, pa.array([len(s) for s in sets], pa.int32()), pa.array([_simhash(s) for s in sets], pa.int64()), prefix]
            own += [pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(LONGS)]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "key", "unit", "n", "fp", "prefix", *_BITS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, key long, unit long, n int, fp long, prefix array<long>, {', '.join(f'{c} long' for c in _BITS)}")


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * UNDER >= F.greatest(n, m) * OVER


def _bits_fit(x: str, y: str, n: Column, m: Column, bits: list[str]) -> Column:
    """Whether fingerprints leave the similarity open: |A xor B| <= (|A| + |B|) (1 - s) / (1 + s), and no fewer shingles differ than bits."""
    differ = reduce(lambda s, c: s + F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))), bits, F.lit(0))
    return differ * (UNDER + OVER) <= (n + m) * (UNDER - OVER)


def _folded() -> list[Column]:
    """The columns of a parity fingerprint folded to FOLDED longs. That is a fingerprint of the whole set; some of its longs alone would be one of some of its shingles."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.col(c) for c in _BITS[i::FOLDED]]).alias(_BITS[i]) for i in range(FOLDED)]


def _near(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) of units that can be similar enough by sizes and bits."""
    x, y = (units.select(F.col("unit").alias(key), *[F.col(c).alias(p + c) for c in ("n", *_BITS)]) for key, p in (("a", "x"), ("b", "y")))
    n, m = F.col("xn"), F.col("yn")
    both = pairs.join(x, "a").join(y, (pairs["b"] == y["b"]) & _sizes_fit(n, m) & _bits_fit("x", "y", n, m, _BITS))
    return saved(both.select("a", pairs["b"]), "candidates")


def _own(pairs: DataFrame, units: DataFrame, docs: DataFrame) -> DataFrame:
    """(unit, text) for the units of pairs; a text that several rows have comes as often."""
    asked = saved(pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct().join(units.select("unit", "key"), "unit"), "asked")
    texts = docs.select(F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return sifted(texts, "key", sieve(asked, "key")).join(asked, "key").select("unit", "text")  # texts that nobody asks for stay where they are


def _verified(pairs: DataFrame, units: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of units whose shingle sets are similar enough. Only texts of pairs that fingerprints leave meet."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            sets = [shingles(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array([len(s) for s in sets], pa.int32()), pa.array([_wide(s).tobytes() for s in sets], pa.binary())], ["unit", "n", "own"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(*(b.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
            keep = [_apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) * (UNDER + OVER) <= (n + m) * (UNDER - OVER) for n, m, x, y in sides]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = shingles(x.as_py(), words), shingles(y.as_py(), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * UNDER >= (len(x) + len(y) - both) * OVER)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = _near(pairs, units)
    wide = saved(_own(pairs, units, docs).mapInArrow(fingerprints, "unit long, n int, own binary").dropDuplicates(["unit"]), "fingerprints")
    full = pairs.join(wide.select(F.col("unit").alias("a"), "n", F.col("own").alias("x")), "a").join(wide.select(F.col("unit").alias("b"), F.col("n").alias("m"), F.col("own").alias("y")), "b")
    first, pairs = pairs, saved(full.select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a long, b long"), "candidates")
    discard(first, wide)
    texts = saved(_own(pairs, units, docs).dropDuplicates(["unit"]), "texts")
    full = pairs.join(texts.select(F.col("unit").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("unit").alias("b"), F.col("text").alias("y")), "b")
    out = saved(full.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "similar")
    discard(pairs, texts)
    return out


def _different(wide: DataFrame) -> DataFrame:
    """wide (token, unit, salt, ...) with one shingle of all that have the same units: the others would bring the same pairs. Sets of units are compared by 128 bits, size and ends."""
    each = [F.bit_xor(F.xxhash64("unit", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sets = wide.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("unit").alias("low"), F.max("unit").alias("high"), *each)
    first = sets.groupBy("k", "low", "high", "x0", "x1").agg(F.min("token").alias("token")).select("token")
    return salted(spread_join(wide, first, "token"), "wide")


def _parts(wide: DataFrame, links: DataFrame) -> DataFrame:
    """(token, unit, salt, part): the units of the shingles that units of several groups have, and the group that links put each unit in."""
    group = saved(roots(links), "roots")
    parts = wide.join(group.withColumnRenamed("node", "unit"), "unit", "left").select("token", "unit", "salt", F.coalesce("root", "unit").alias("part"))
    parts = saved(parts, "parts")
    split = parts.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    return saved(spread_join(parts, split, "token"), "parts").withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(SALTS)).cast("int"))


def similar_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, root) per row of docs; root names the group of documents that similar pairs join. See _groups; what needs Python has run when it returns."""
    conf, before = docs.sparkSession.conf, small_batches(docs.sparkSession)
    try:
        return _groups(docs, words)
    finally:
        for name, rows in before.items():
            conf.set(name, rows)


def _groups(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, root) per row of docs; root names the group of documents that similar pairs join.

    Reads doc_id and text. Null and empty texts are one group; texts with the same shingles are too.
    """
    rows = salted(_sketches(docs, words), "sketches")
    units = saved(rows.groupBy("unit").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "fp", *_BITS)]), "units")

    # A shingle's units are counted where they are. Two units of a shingle are a pair at once; only shingles of more meet their units again.
    tokens = rows.select("unit", "salt", F.explode("prefix").alias("token"))
    ends = tokens.groupBy("token").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.count(F.lit(1)).alias("k")).where("a < b")
    ends = saved(ends, "ends")
    hubs = saved(ends.where("k > 2").select("token", "a"), "hubs")
    wide = salted(sifted(tokens, "token", sieve(hubs, "token")).join(hubs, "token").select("token", "unit", "a").distinct(), "wide")
    wide = _different(wide)
    stars = ends.select("a", "b").union(wide.where("unit <> a").select("a", F.col("unit").alias("b")))

    prints = saved(units.groupBy("fp").agg(F.min("unit").alias("first")), "prints")
    alike = units.join(prints, "fp").where("unit <> first").select(F.col("first").alias("a"), F.col("unit").alias("b"))
    close = saved(near_links(docs.sparkSession, prints.select("fp")), "close")
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    links = _verified(stars.union(alike).union(close).distinct(), units, docs, words)
    parts = _parts(wide, links)

    # Then a shingle's units meet one of them by lot, another for each shingle, if they are in different groups. What a group of
    # near copies holds together is found so, without its pairs.
    for turn in range(LOTS):
        lot = F.min_by(F.struct("unit", "part"), F.xxhash64("unit", "token", F.lit(turn))).alias("hub")
        met = spread_join(parts, parts.groupBy("token").agg(lot), "token").where(F.col("part") != F.col("hub.part"))
        met = met.select(F.least("unit", "hub.unit").alias("a"), F.greatest("unit", "hub.unit").alias("b")).distinct()
        links = saved(links.union(_verified(met, units, docs, words)), "links")
        parts = _parts(parts.select("token", "unit", "salt"), links)

    step = F.floor(F.log("n") / F.log(F.lit(UNDER / OVER)) + 1e-9)  # the sizes of a pair are in one step, or in two next to each other
    early = _BITS[:FOLDED]
    one = parts.drop("salt").join(units.where("n > 0").select("unit", "n", *_folded()), "unit").withColumn("step", step)
    other = one.select("token", "step", F.col("unit").alias("b"), F.col("n").alias("m"), F.col("part").alias("apart"), *[F.col(c).alias(f"y{c}") for c in early])
    one = one.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    n, m = F.col("n"), F.col("m")
    ordered = (n < m) | ((n == m) & (F.col("unit") < F.col("b")))
    meets = (one["token"] == other["token"]) & (one["step"] == other["step"]) & (F.col("part") != F.col("apart")) & ordered & _sizes_fit(n, m) & _bits_fit("", "y", n, m, early)
    across = one.join(other, meets).select(F.col("unit").alias("a"), "b")  # a pair that cannot be similar is never a row
    group = saved(roots(links.union(_verified(across.distinct(), units, docs, words))), "roots")
    own = spread_join(rows.select("doc_id", "key", "unit", "salt"), group.withColumnRenamed("node", "unit"), "unit", how="left")
    return own.select("doc_id", "key", F.coalesce("root", "unit").alias("root"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs that stay, one a group: the row of the group's smallest doc_id, with its columns. See similar_groups."""
    return keep_first(docs, similar_groups(docs, words))
