"""Merges that follow each other, and names alike, against plain versions."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brasslark.operators import fuzzy, merges


def pairs(spark, rows):
    return spark.createDataFrame(rows, "loser string, survivor string")


def ends(spark, rows):
    return {r["loser"]: (r["survivor"], r["reason"]) for r in merges.followed(pairs(spark, rows)).collect()}


def test_chains_end_at_the_last(spark):
    assert ends(spark, [("a", "b"), ("b", "c"), ("d", "d")]) == {"a": ("c", "ok"), "b": ("c", "ok")}
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    assert ends(spark, chain) == {a: ("n070", "ok") for a, _ in chain}
    assert ends(spark, []) == {}


def test_circles_are_told(spark):
    got = ends(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("p", "q"), ("m", "z"), ("m", "y")])
    assert got == {**{n: (None, "cycle") for n in "abcx"}, "p": ("q", "ok"), "m": ("y", "ok")}


def test_random_merges_equal_a_walk(spark):
    rng = random.Random(8)
    rows = [(f"v{i}", f"v{rng.randrange(60)}") for i in rng.sample(range(60), 45)] + [("w1", "w2"), ("w2", "w1"), ("w3", "w1")]
    to = {a: b for a, b in rows if a != b}
    want = {}
    for a in to:
        at, seen = a, set()
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        want[a] = (None, "cycle") if at in seen else (at, "ok")
    assert ends(spark, rows) == want and {"ok", "cycle"} == {r for _, r in want.values()}


def test_edges_of_a_chain(spark):
    edges = spark.createDataFrame([("a", "r", "x", 1, 0.5), ("c", "r", "x", 2, 0.9), ("a", "r", "b", 1, 0.1), ("x", "s", "b", 4, 0.2), ("k", "r", "l", 1, 0.3)], "src string, rel string, dst string, mentions long, confidence double")
    got = {tuple(r) for r in merges.merged(edges, pairs(spark, [("a", "b"), ("b", "c"), ("k", "l"), ("l", "k")])).collect()}
    assert got == {("c", "r", "x", 3, 0.9), ("x", "s", "c", 4, 0.2), ("k", "r", "l", 1, 0.3)}


def test_plan_and_counts(spark):
    wanted = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("no", "c"), ("d", "no"), ("e", "f"), ("f", "e")], "node string, into string")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "name string")
    got = {(r["node"], r["into"]): (r["reason"], r["survivor"]) for r in merges.plan(wanted, nodes).collect()}
    assert got == {("a", "b"): ("ok", "c"), ("b", "c"): ("ok", "c"), ("c", "c"): ("same", None), ("no", "c"): ("node_missing", None), ("d", "no"): ("target_missing", None), ("e", "f"): ("cycle", None), ("f", "e"): ("cycle", None)}
    after = spark.createDataFrame([(n,) for n in "cdef"], "name string")
    assert tuple(merges.reconciled(nodes, after, pairs(spark, [("a", "b"), ("b", "c"), ("e", "f"), ("f", "e")])).first()) == (6, 4, 2, True)


def names(seed: int = 6) -> list[str]:
    rng = random.Random(seed)
    heads = ["microsoft", "general motors", "supplier 0000", "ab", "a", "münchen re", "aaaaaaaaaa", "international business"]
    out = set(heads) | {"imcrosoft", "micro soft", "microsft corp"}
    for h in heads * 6:
        s = list(h + rng.choice(["", " group", " 12", str(rng.randint(0, 999))]))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", "o", " "])
        out.add("".join(s))
    return sorted(out | {""})


@pytest.mark.parametrize("least", [0.5, 0.72, 0.88, 1.0])
def test_alike_equals_all_pairs(spark, least):
    some = names()
    left, right = some[::2] + some[:5], some[1::2] + some[:20]
    rows = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "s string").repartition(3)
    got = {(r["x"], r["y"]): r["ratio"] for r in fuzzy.alike(rows(left), rows(right), least).collect()}
    want = {(a, b): r for a in set(left) for b in set(right) if a and b and (r := SequenceMatcher(None, a, b).ratio()) >= least}
    assert got == pytest.approx(want) and len(want) > 5


@pytest.mark.parametrize("least, others", [(0.875, False), (0.88, True), (0.94, True)])
def test_names_with_running_numbers_meet_by_their_variants(spark, monkeypatch, least, others):
    """They share nearly all tokens with all other names, so pairs of tokens would be all pairs. Strings with many variants still meet by tokens, and no pair comes twice."""
    saved, real = [], fuzzy.saved
    monkeypatch.setattr(fuzzy, "saved", lambda df, name: (saved.append((name, out := real(df, name))), out)[1])
    right = [f"supplier {i:09d}" for i in range(0, 3000, 7)] + ["supplier 00000007", "süpplier 000000007", "supplier 0000000070 group of companies"] * others
    left = [n.replace("u", "v") for n in right[::20]] + ["svpplier 000000007", "suppleir 000000014", "supplier 000000070 group of company"] * others
    rows = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, ""]], "s string").repartition(3)
    got = [(r["x"], r["y"], r["ratio"]) for r in fuzzy.alike(rows(left), rows(right), least).collect()]
    want = {(a, b): r for a in set(left) for b in set(right) if (r := SequenceMatcher(None, a, b).ratio()) >= least}
    assert len(got) == len(want) and {g[:2]: g[2] for g in got} == pytest.approx(want) and len(want) > 20
    assert ("tokens" in dict(saved)) == others  # only other lengths need them
    if not others:
        assert dict(saved)["ratios"].count() <= 1.2 * len(want)


@pytest.mark.parametrize("text, gone", [("abca", 0), ("abca", 2), ("aab", 1), ("é😀x", 2), ("ab", 2)])
def test_variants_are_all_that_is_left(spark, text, gone):
    from itertools import combinations

    got = spark.createDataFrame([(text,)], "s string").select(fuzzy.without(F.col("s"), gone).alias("v")).first()["v"]
    assert sorted(got) == sorted({"".join(c) for c in combinations(text, len(text) - gone)})
