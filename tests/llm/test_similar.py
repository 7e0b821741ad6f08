"""The near-duplicate stage against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from brasslark.llm import common, similar
from tests.llm.conftest import SYLLABLES, prose


def plain_kept(rows: list[tuple[int, str]]) -> tuple[set[int], int]:
    def own(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, top, pairs = {d: own(t) for d, t in rows}, {d: d for d, _ in rows}, 0

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
            x, y = sorted((find(a), find(b)))
            top[y] = x
            pairs += 1
    return {d for d in top if find(d) == d}, pairs


def awkward(seed: int = 3) -> list[tuple[int, str]]:
    """Copies with words changed at random or cut at the end, under a common line; a chain; a cluster of near copies."""
    rng, texts = random.Random(seed), []
    line = prose(rng, SYLLABLES["bb"], 30)
    for i in range(25):
        base = prose(rng, SYLLABLES["aa"], rng.randint(20, 150)).split()
        texts.append(" ".join(base))
        for k in range(8):
            own = list(base)
            for _ in range(k // 2):
                own[rng.randrange(len(own))] = f"w{rng.random()}"
            texts.append(" ".join(own[: len(own) - 2 * k] if k % 2 else own))
        if i % 3 == 0:
            texts[-9:] = [f"{line} {t}" for t in texts[-9:]]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)]
    texts += ["", "one two", "one  TWO", "one three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_all_similar_pairs(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want, pairs = plain_kept(rows)
    assert pairs > 200 and kept == want


def test_near_copies_that_are_not_similar_are_no_pairs(spark, monkeypatch):
    """Copies of one text with so many words changed that no two are similar: before they are pairs, whole fingerprints are compared, not parts of them."""
    rng, met = random.Random(8), []
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(0, 150, 6), 3):
            own[at] = f"n{i} {at}"
        rows.append((i, " ".join(own)))
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: (met.append(pairs.count()), verified(pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.keep_one(docs).select("doc_id").collect()} == plain_kept(rows)[0]
    assert met[-1] < 400  # of 4005


def test_sieves_keep_all_keys(spark):
    """Keys of any sign, beside the bound of the bitmap, survive; most others don't."""
    keys = [0, -1, 63, 64, common.SIEVE, -common.SIEVE, 2**63 - 1, -(2**63), *[(k * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for k in range(1, 300)]]
    asked = spark.createDataFrame([(k,) for k in keys], "key long")
    rows = asked.union(spark.range(5000).select((F.col("id") * 7919 + 1_000_003).alias("key")))
    kept = [r["key"] for r in common.sifted(rows, "key", common.sieve(asked, "key")).collect()]
    assert set(keys) <= set(kept) and len(kept) < len(keys) + 50


def test_one_shingle_of_each_set_of_units(spark):
    rows = [(t, u, 0) for t, units in enumerate([(1, 2, 3), (3, 2, 1), (1, 2, 4), (1, 2), (5, 6, 7), (1, 2, 3)]) for u in units]
    got = {r["token"] for r in similar._different(spark.createDataFrame(rows, "token long, unit long, salt int")).collect()}
    assert got == {0, 2, 3, 4}


def test_prefixes_of_similar_texts_meet():
    """Whatever the commonness of words is, two sets of 0.8 or more share a shingle of their prefixes."""
    rng, most = random.Random(5), np.random.default_rng(6)
    commonness = most.integers(0, 60, 1 << similar.COUNTERS).astype(np.int16)
    met = 0
    for _ in range(300):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 120))]
        other = list(base)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other))] = "new"
        x, y = (similar._words(" ".join(t)) for t in (base, other))
        a, b = (similar._windows(w, 5) for w in (x, y))
        both = len(np.intersect1d(a, b))
        if both * 5 >= (len(set(a)) + len(set(b)) - both) * 4:
            met += 1
            assert len(np.intersect1d(similar._prefix(x, 5, commonness), similar._prefix(y, 5, commonness)))
    assert met > 50
