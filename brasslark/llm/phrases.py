"""Phrase collocations from compressed position bitmaps.

Texts are laid out in shards of one language each: a position a word, and an empty one where a piece ends, so nothing that is
shifted by one runs from a piece into the next. A word's bitmap is kept as its bytes that are not zero, each with its block of
eight positions. A phrase is extended by shifting its bitmap by one and ANDing it with the bitmaps of all words that have bits
in the same blocks, at once; the popcounts of what is left, summed over shards, are the phrases' frequencies. Bytes, rather than
longer machine words, keep the number of ANDs without a hit small.

A phrase is never more frequent than its parts. So shards first count words, then pairs of frequent words, then go
depth-first, pair by pair, through longer phrases whose pairs are all frequent. What is frequent is decided over all
shards each time, and a shard gets back the words and pairs of its own that are. No list of all words or pairs leaves Spark.
A shard crosses the network in short rows (runs of positions, words, pairs), which Spark puts in order, and a task's Python holds
one shard at a time: neither the size of the input nor that of a partition changes what a task holds.

Texts and their words are as in the contract of op13: A-Z lower-cased, split at PIECES and at spaces and tabs; a null text is
empty, a null language is `und`. Repeated rows count again, ties are told in `collocations`, and no rows give no phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.llm.common import bounded_batches, discard, given_back, saved
from brasslark.operators.scans import placed

PIECES = ".,;:!?\n\x0b\x0c\r"
#: Bytes of text in a shard (a longer text is a shard by itself), and ANDs done at once.
SHARD, ANDS = 1 << 24, 1 << 20
#: Positions in a row of a shard, and rows that Python gives at once.
RUN, ROWS = 1 << 14, 1 << 13
#: Words of the longest phrases, and how often a phrase occurs at least.
LONGEST, LEAST = 4, 30

_ENDS, _SPACE = 10, 32
_FOLDED = bytes(_ENDS if chr(b) in PIECES else _SPACE if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def laid_out(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The different words of a text, and the number of the word at each position; -1 where a piece ends."""
    raw = np.frombuffer(text.translate(_FOLDED), np.uint8)
    inside = (raw != _SPACE) & (raw != _ENDS)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.string()), np.empty(0, np.int32)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == _ENDS), starts)
    at = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    codes = np.full(at[-1] + 1, -1, np.int32)
    codes[at] = coded.indices.to_numpy()
    return coded.dictionary.cast(pa.string()), codes


class Bitmaps(NamedTuple):
    """Bytes that are not zero, in the order of owner and block: whose they are, which eight positions, which of them."""

    owner: np.ndarray
    block: np.ndarray
    bits: np.ndarray


def _in_order(*columns: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """Integer columns (values, upper bound), sorted by the first, then the second, and so on."""
    widths = [max(1, int(bound).bit_length()) for _, bound in columns]
    if sum(widths) < 64:  # one sort of one number a row, in place
        key = np.zeros(len(columns[0][0]), np.int64)
        for (values, _), w in zip(columns, widths, strict=True):
            key <<= w
            key |= values
        key.sort()
        out = []
        for (values, _), w in zip(reversed(columns), reversed(widths), strict=True):
            out.append(np.bitwise_and(key, (1 << w) - 1, out=np.empty(len(key), values.dtype), casting="unsafe"))
            key >>= w
        return out[::-1]
    order = np.lexsort([values for values, _ in reversed(columns)])
    return [values[order] for values, _ in columns]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    differ = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return np.concatenate((np.zeros(min(len(columns[0]), 1), np.int64), np.flatnonzero(differ) + 1))


class Shard:
    """The words' bitmaps of a shard, by word and by block. codes has the word at each position, -1 for none; words has how many there are."""

    def __init__(self, codes: np.ndarray, words: int):
        at = np.flatnonzero(codes >= 0).astype(np.int32)
        self.words, self.blocks = words, (len(codes) >> 3) + 1
        word, at = _in_order((codes[at], words), (at, len(codes)))
        block, bit = at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
        first = _firsts(word, block)
        self.own = Bitmaps(word[first], block[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit)
        self.by_block, self.word, self.bits = _in_order((self.own.block, self.blocks), (self.own.owner, words), (self.own.bits, 255))
        self.start = np.searchsorted(self.by_block, np.arange(self.blocks + 2, dtype=np.int32)).astype(np.int32)

    def batches(self, some: Bitmaps) -> Iterator[Bitmaps]:
        """The bitmaps cut between owners into parts of about ANDS ANDs."""
        cost = np.cumsum(self.start[some.block + 1] - self.start[some.block] + 1, dtype=np.int64)
        first = _firsts(some.owner)
        last = np.append(first[1:], len(some.owner)) if len(first) else first
        ends, at = cost[last - 1], 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ANDS)))
            yield Bitmaps(*(c[first[at] : last[to - 1]] for c in some))
            at = to

    def extended(self, some: Bitmaps, last: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """All owners extended by one word: shift, AND. Gives each longer phrase's owner before and new word, and its bitmap.

        last has the last word of each owner; with pairs (sorted, first * words + second) only these may come to stand together.
        """
        up, over = some.bits << np.uint8(1), some.bits >> np.uint8(7)
        stay, carry = np.flatnonzero(up), np.flatnonzero(over)
        owner = np.concatenate((some.owner[stay], some.owner[carry]))
        block = np.concatenate((some.block[stay], some.block[carry] + 1))
        bits = np.concatenate((up[stay], over[carry]))
        n = self.start[block + 1] - self.start[block]
        mine = np.repeat(np.arange(len(n), dtype=np.int32), n)
        theirs = np.repeat(self.start[block] - (np.cumsum(n, dtype=np.int32) - n), n)
        theirs += np.arange(len(mine), dtype=np.int32)
        both = bits[mine] & self.bits[theirs]
        hit = np.flatnonzero(both)
        owner, word, block, both = owner[mine[hit]], self.word[theirs[hit]], block[mine[hit]], both[hit]
        if pairs is not None:
            pair = last[owner].astype(np.int64) * self.words + word
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            keep = np.flatnonzero(pairs[at] == pair) if len(pairs) else np.empty(0, np.int64)
            owner, word, block, both = owner[keep], word[keep], block[keep], both[keep]
        owner, word, block, both = _in_order((owner, len(last)), (word, self.words), (block, self.blocks), (both, 255))
        first = _firsts(owner, word, block)
        owner, word, block = owner[first], word[first], block[first]
        both = np.bitwise_or.reduceat(both, first) if len(first) else both
        first = _firsts(owner, word)
        longer = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
        return owner[first], word[first], Bitmaps(longer, block, both)


def popcounts(some: Bitmaps) -> np.ndarray:
    """Set bits of each owner."""
    first = _firsts(some.owner)
    return np.add.reduceat(np.bitwise_count(some.bits).astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def pair_counts(shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, frequencies) of all pairs of a shard; a row of phrases is a phrase."""
    every = np.arange(shard.words)
    for some in shard.batches(shard.own):
        before, word, longer = shard.extended(some, every)
        yield np.stack((before, word), axis=1), popcounts(longer)


def long_counts(shard: Shard, pairs: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, frequencies) of all phrases of three to `longest` words whose pairs are all in pairs, depth-first."""

    def grown(phrases: np.ndarray, bitmaps: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for some in shard.batches(bitmaps):
            before, word, longer = shard.extended(some, phrases[:, -1], pairs)
            found = np.column_stack((phrases[before], word))
            if found.shape[1] > 2:
                yield found, popcounts(longer)
            if found.shape[1] < longest and len(found):
                yield from grown(found, longer)

    yield from grown(np.arange(shard.words)[:, None], shard.own)


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, lang, at, word, k, codes): the texts laid out; what a task holds is written as soon as it has shard_bytes of text.

    A shard has a row for each of its words (at is the word's number, k how often it occurs) and one for each RUN of its positions (at is the run's number, codes the words' numbers).
    """
    names = ["shard", "lang", "at", "word", "k", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, k = defaultdict(list), defaultdict(int), 0

        def written(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal k
            sizes.pop(lang)
            words, codes = laid_out(b"\n".join(held.pop(lang)))
            number, k = (k << 24) | TaskContext.get().partitionId(), k + 1  # small numbers pack well
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            for columns, step in (
                ((words, pa.array(counts, pa.int64()), pa.nulls(len(words), pa.binary())), ROWS),
                ((pa.nulls(n := -(-len(codes) // RUN), pa.string()), pa.nulls(n, pa.int64()), pa.array([codes[i : i + RUN].tobytes() for i in range(0, len(codes), RUN)], pa.binary())), max(1, ROWS * 512 // RUN)),
            ):
                n = len(columns[0])
                rows = [pa.repeat(pa.scalar(number, pa.int64()), n), pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(np.arange(n), pa.int32()), *columns]
                rows = pa.RecordBatch.from_arrays(rows, names)
                yield from (rows.slice(i, step) for i in range(0, n, step))
            del words, codes, counts, columns, rows
            given_back()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                held[lang].append(text)
                sizes[lang] += len(text) + 1
                if sum(sizes.values()) >= shard_bytes:
                    yield from written(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from written(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "shard long, lang string, at int, word string, k long, codes binary")


#: What the rows of a dealt shard are, in their order: runs of positions (number, codes), words (number in the shard, id), pairs (ids).
_RUNS, _WORDS, _PAIRS = range(3)


def _dealt(shards: DataFrame, own: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(key, x, y, codes): all rows of a shard in one task, one shard after the other. The key is a single long, so the rows are put in order by a radix sort."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = shards.where("codes is not null").select("shard", F.lit(_RUNS).alias("kind"), F.col("at").cast("long").alias("x"), none("long").alias("y"), "codes")
    rows = rows.union(own.select("shard", F.lit(_WORDS), F.col("at").cast("long"), "id", none("binary")))
    if pairs is not None:
        rows = rows.union(pairs.select("shard", F.lit(_PAIRS), "a", "b", none("binary")))
    return rows.repartition("shard").select((F.col("shard") * 4 + F.col("kind")).alias("key"), "x", "y", "codes").sortWithinPartitions("key")


def _each(batches: Iterator[pa.RecordBatch], work: Callable[[int, Shard, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What work gives for the shards of dealt rows, one after the other. It gets a shard's number, the shard with its frequent words only, their ids, and its pairs (sorted, first * words + second).

    Work has the only reference to its shard, so that it is gone before the next one is put together.
    """
    number, held = None, ([], [], [])

    def put_together() -> tuple[int, Shard, np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(c for _, c in sorted(held[_RUNS])), np.int32)
        held[_RUNS].clear()
        at, ids = (np.concatenate(c) for c in zip(*held[_WORDS], strict=True))
        held[_WORDS].clear()
        place = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last is for positions without a word
        place[at] = np.arange(len(at))
        codes, by = place[codes], np.argsort(ids)
        a, b = (by[np.searchsorted(ids, np.concatenate(c), sorter=by)] for c in zip(*held[_PAIRS], strict=True)) if held[_PAIRS] else (np.empty(0, np.int64),) * 2
        held[_PAIRS].clear()
        a = a * len(at)
        a += b
        a.sort()
        return number, Shard(codes, len(at)), ids, a

    def worked() -> Iterator[pa.RecordBatch]:
        if held[_WORDS]:  # else no word of it is frequent
            yield from work(*put_together())
            given_back()

    for batch in batches:
        key = batch.column("key").to_numpy()
        first = _firsts(key)
        for start, end in zip(first, np.append(first[1:], len(key)), strict=True):
            this, kind = divmod(int(key[start]), 4)
            if this != number:
                yield from worked()
                number, held = this, ([], [], [])
            x, y, codes = (batch.column(c)[start:end] for c in ("x", "y", "codes"))
            held[kind].extend(zip(x.to_pylist(), codes.to_pylist(), strict=True) if kind == _RUNS else [(x.to_numpy().copy(), y.to_numpy().copy())])
    yield from worked()


def _pairs(shards: DataFrame) -> DataFrame:
    """(shard, a, b, k) of all pairs of frequent words of all shards, which are dealt."""

    def counted(number: int, shard: Shard, ids: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found, k in pair_counts(shard):
            columns = [pa.array(np.full(len(k), number)), pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]]), pa.array(k)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "a", "b", "k"])

    return shards.mapInArrow(lambda batches: _each(batches, counted), "shard long, a long, b long, k long")


def _longer(shards: DataFrame, longest: int) -> DataFrame:
    """(w0 ... , k) of the phrases of three or more words of all shards, which are dealt with their pairs; the last words of shorter ones are null."""
    names = [f"w{i}" for i in range(longest)]

    def counted(_: int, shard: Shard, ids: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for found, k in long_counts(shard, pairs, longest) if len(pairs) else ():
            columns = [pa.array(ids[found[:, i]]) if i < found.shape[1] else pa.nulls(len(k), pa.int64()) for i in range(longest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(k)], [*names, "k"])

    return shards.mapInArrow(lambda batches: _each(batches, counted), ", ".join(f"{n} long" for n in names) + ", k long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words that occur `least` times or more in their language, and (lang, n) with the words of each.

    phrase is the array of its words.
    """
    with bounded_batches(docs.sparkSession):
        return _frequent_phrases(docs, least, longest, shard_bytes)


def _frequent_phrases(docs: DataFrame, least: int, longest: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    shards = saved(_shards(docs, shard_bytes), "shards")
    each = shards.where("word is not null")
    totals = saved(each.groupBy("lang").agg(F.sum("k").alias("n")), "totals")

    words = each.groupBy("lang", "word").agg(F.sum("k").alias("f")).where(F.col("f") >= least)
    # ids by frequency: most of what is shuffled has small ones
    words = saved(placed(words, [], [F.desc("f"), F.col("lang"), F.col("word")], "id"), "words")
    of_shard = saved(each.join(words, ["lang", "word"]).select("shard", "at", "id"), "own")

    pairs = _pairs(_dealt(shards, of_shard)).withColumn("f", F.sum("k").over(Window.partitionBy("a", "b"))).where(F.col("f") >= least)
    pairs = saved(pairs.select("shard", "a", "b", "f"), "pairs")
    longer = _longer(_dealt(shards, of_shard, pairs), longest)
    names = [f"w{i}" for i in range(longest)]
    longer = longer.groupBy(*names).agg(F.sum("k").alias("f")).where(F.col("f") >= least)
    two = pairs.groupBy(F.col("a").alias("w0"), F.col("b").alias("w1")).agg(F.first("f").alias("f"))
    found = two.select("w0", "w1", *[F.lit(None).cast("long").alias(n) for n in names[2:]], "f").union(longer)
    for i, n in enumerate(names):
        own = words.select(F.col("id").alias(n), F.col("word").alias(f"s{i}"), *(["lang"] if i == 0 else []))
        found = found.join(own, n, "inner" if i < 2 else "left")
    phrase = F.array_compact(F.array(*[f"s{i}" for i in range(longest)]))
    found = found.select("lang", phrase.alias("phrase"), "f").union(words.select("lang", F.array("word"), "f"))
    found = saved(found.select("lang", "phrase", F.size("phrase").alias("words"), "f"), "phrases")
    discard(shards, of_shard, pairs)
    return found, totals


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, longest: int = LONGEST, share: int = 80, shard_bytes: int = SHARD) -> DataFrame:
    """The `top` best phrases of two to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's frequency. Cut after its first k words, it has l and r, the frequencies of both parts, and the score floor(2000000 a / (l + r));
    the cut of the lowest score counts, of equal ones the first. A phrase inside a longer one that makes `share` percent of its
    occurrences is left out. Order: score, a (both descending), phrase by bytes. n counts the language's words.
    """
    found, totals = frequent_phrases(docs, least, longest, shard_bytes)
    many = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    f = lambda part, value: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(value))
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("cut"))).withColumn("right", F.slice("phrase", F.col("cut") + 1, F.col("words")))
    cuts = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("million", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a")).withColumn("score", F.expr("million div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.score", "low.l", "low.r")

    inner = many.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inner.groupBy("lang", F.slice("phrase", F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * share))
    kept = kept.withColumn("phrase", F.array_join("phrase", " "))
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
