"""Mined URL rules are all kept, however many there are before pruning."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brasslark.llm import urls


def test_supersets_do_not_crowd_out_a_rule(spark):
    strong = "/".join(f"{c}x" for c in "abcdefghijkl")
    rows = [(i, f"http://h{i}.info/{strong}") for i in range(60)]
    rows += [(i, f"http://h{i}.info/weak") for i in range(60, 90)]
    rows += [(i, f"http://h{i}.info/fine{i % 3}") for i in range(90, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 90) for i in range(300) if i not in (59, 89)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == set(range(90))


def plain_best(rows: list[tuple[tuple[str, ...], str]], asked: list[tuple[str, ...]], least: float, sure: float) -> list[tuple | None]:
    """The best of all rules, none pruned, for each token set."""
    n, seen = len(rows), {}
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), size):
                seen.setdefault(some, {}).setdefault(verdict, 0)
                seen[some][verdict] += 1
    rules = [(some, k / sum(by.values()), k / n, v) for some, by in seen.items() for v, k in by.items() if k >= least * n and k / sum(by.values()) >= sure]
    out = []
    for tokens in asked:
        fits = [(c, s, v) for some, c, s, v in rules if set(some) <= set(tokens)]
        out.append(max(fits) if fits else None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_decide_as_all_rules_do(spark, seed):
    """Against every itemset counted plainly, without pruning. Tokens that always go together, that all rows have, and pure ones are among them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        t = {c for c in "abcdefg" if rng.random() < 0.4} | {"all"} | ({"twin1", "twin2"} if rng.random() < 0.5 else set())
        if rng.random() < 0.2:
            t.add("pure")
        bad = "pure" in t or {"a", "b"} <= t or ("c" in t and "d" not in t and rng.random() < 0.95)
        rows.append((tuple(sorted(t)), "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    index = urls.mine(df, 0.04, 1, 0.9)
    got = {tuple(r["tokens"]): r["best"] for r in urls.fired(df, index).collect()}
    asked = sorted({t for t, _ in rows})
    for tokens, want in zip(asked, plain_best(rows, asked, 0.04, 0.9), strict=True):
        best = got.get(tokens)
        assert (best is None) == (want is None)
        if best is not None:
            assert (best["confidence"], best["support"]) == pytest.approx(want[:2])
            assert best["verdict"] == want[2]


def test_long_urls_keep_all_tokens(spark):
    """Forty tokens a URL from one template: those that stand together are mined as one, so no token has to go."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [(i, f"http://h.info/{'/'.join(words)}/{'last-bad' if i % 3 == 0 else 'last-fine'}/{rng.choice('xyz')}q") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "page_id long, bad boolean")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert len(got) == 300 and all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_mined_rules_on_held_out_urls(spark):
    """What the mined rules say of URLs that a listed rule fits and nothing was learned from."""
    rng = random.Random(6)
    rows = [(i, f"http://{rng.choice(['m', 'www', 'blog'])}.x{i % 40}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{i}.html?{rng.choice(['a', 'b'])}=1") for i in range(1500)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("held_out and rule is not null and mined is not null")
    n, right = out.agg(F.count(F.lit(1)), F.sum((F.col("mined") == F.col("verdict")).cast("int"))).first()
    assert n > 50 and right / n >= 0.95
