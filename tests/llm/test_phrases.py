"""op13: bitmaps and collocations against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brasslark.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counted(texts, longest: int = 4) -> Counter:
    return Counter(tuple(p[i : i + k]) for t in texts for p in pieces(t) for k in range(1, longest + 1) for i in range(len(p) - k + 1))


def plain(rows, top: int, least: int, share: int = 80) -> set[tuple]:
    by, out = defaultdict(list), set()
    for lang, text in rows:
        by["und" if lang is None else lang].append(text)
    for lang, texts in by.items():
        f = counted(texts)
        n = sum(k for p, k in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= share * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def awkward(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "ü-x", "a b", "\x01", "x" * 300, "city", "new", "york", "and"]
    rows = []
    for i in range(200):
        body = [rng.choice(words) if rng.random() < 0.6 else "new york city hall" for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; "]) for w in body)))
    rows += [rows[0]] * 40 + [("fr", None), ("fr", ""), ("fr", " .,\n"), (None, "alone")]
    rows.append(("en", " ".join(rng.choices(words, k=30_000))))
    return rows


@pytest.mark.parametrize("shard_bytes", [1, 700, 1 << 23])
def test_collocations_equal_a_plain_count(spark, shard_bytes):
    rows = awkward()
    docs = spark.createDataFrame([(i, *r, 1, "r") for i, r in enumerate(rows)], "doc_id long, lang string, text string, score int, phrase string").repartition(4)
    found = [tuple(r) for r in phrases.collocations(docs, top=60, least=5, shard_bytes=shard_bytes).collect()]
    want = plain(rows, 60, 5)
    assert len(found) == len(set(found)) and set(found) == want and max(r[1] for r in found) == 60


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB .,\t\né", max_size=300), st.integers(1, 40))
def test_bitmaps_count_all_phrases(text, ands):
    words, codes = phrases.laid_out(text.encode())
    names, want = words.to_pylist(), counted([text], 5)
    assert Counter(names[c] for c in codes if c >= 0) == Counter({p[0]: k for p, k in want.items() if len(p) == 1})
    shard = phrases.Shard(codes, len(names))
    before, phrases.ANDS = phrases.ANDS, ands
    try:
        found = Counter()
        pairs = []
        for rows, k in phrases.pair_counts(shard):
            pairs += (rows[:, 0] * shard.words + rows[:, 1]).tolist()
            found.update({tuple(names[w] for w in row): int(n) for row, n in zip(rows, k, strict=True)})
        for rows, k in phrases.long_counts(shard, np.sort(np.array(pairs, np.int64)), 5):
            found.update({tuple(names[w] for w in row): int(n) for row, n in zip(rows, k, strict=True)})
    finally:
        phrases.ANDS = before
    assert found == Counter({p: k for p, k in want.items() if len(p) > 1})


def test_scores_are_exact(spark):
    """Products of 10^19 and more, which 64 bits do not hold."""
    df = spark.createDataFrame([(9 * 10**15, 4 * 10**18, 5 * 10**18 + 1)], "a long, l long, r long")
    got = df.withColumn("million", phrases.F.lit(2_000_000).cast("decimal(7,0)") * phrases._exact("a")).selectExpr("million div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) AS s").first()["s"]
    assert got == 2_000_000 * 9 * 10**15 // (9 * 10**18 + 1)


def test_rows_and_batches_of_a_shard_are_short(spark, monkeypatch):
    """No row has a whole shard's positions, and Python gets few of them at once, however many shards a partition has."""
    tables = {}
    real = phrases.saved
    monkeypatch.setattr(phrases, "saved", lambda df, name: tables.setdefault(name, real(df, name)))
    monkeypatch.setattr(phrases, "discard", lambda *_: None)
    names = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(n) for n in names]
    docs = spark.range(40).selectExpr("'en' AS lang", "repeat('a b c d e f g h ', 10000) AS text").repartition(2)
    found = phrases.collocations(docs, shard_bytes=200_000).collect()
    assert {r["n"] for r in found} == {40 * 80_000} and [spark.conf.get(n) for n in names] == before
    shards = tables["shards"].where("codes is not null").selectExpr("count(distinct shard) AS n", "max(length(codes)) AS m").first()
    assert shards["n"] >= 20 and shards["m"] <= 4 * phrases.RUN
    monkeypatch.setattr(phrases, "given_back", lambda: None)
    sizes = lambda batches: (phrases.pa.RecordBatch.from_arrays([phrases.pa.array([b.nbytes])], ["n"]) for b in batches)
    with phrases.bounded_batches(spark):
        dealt = phrases._dealt(tables["shards"], tables["own"], tables["pairs"]).mapInArrow(sizes, "n long")
        got = [r["n"] for r in dealt.collect()]
    assert max(got) <= 6_000_000 < sum(got)


def test_a_shard_is_gone_before_the_next_is_put_together():
    import gc
    import weakref

    columns = ["key", "x", "y", "codes"]

    def rows(shard: int):
        codes = np.array([0, 1, 0, 1], np.int32).tobytes()
        for kind, x, y, c in ((0, [0], None, [codes]), (1, [0, 1], [7, 5], None), (2, [7], [5], None)):
            n = len(x)
            pa = phrases.pa
            yield pa.RecordBatch.from_arrays([pa.array([shard * 4 + kind] * n), pa.array(x), pa.array(y or [None] * n, pa.int64()), pa.array(c or [None] * n, pa.binary())], columns)

    alive, got = [], []

    def work(number, shard, ids, pairs):
        own = type("Own", (np.ndarray,), {})
        shard.own = phrases.Bitmaps(shard.own.owner.view(own), *shard.own[1:])  # an array that a weak reference can follow
        gc.collect()
        assert not any(r() is not None for r in alive)
        alive.append(weakref.ref(shard.own.owner))
        got.append((number, ids.tolist(), pairs.tolist(), [k.tolist() for _, k in phrases.pair_counts(shard)]))
        yield number

    assert list(phrases._each((b for s in (3, 4, 9) for b in rows(s)), work)) == [3, 4, 9]
    assert got == [(s, [7, 5], [1], [[2, 1]]) for s in (3, 4, 9)]
