"""op1, op4, op6, op8: mixing, near and exact duplicates, packing."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brasslark.llm import exact, mixing, packing, queries, simhash
from brasslark.llm.common import shared_dir
from tests.conftest import SMALL
from tests.oracle import connect, plain

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    ours, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and plain(ours) == plain(theirs)


def filled(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by water filling, one source at a time."""
    total, out, left = share * sum(sizes.values()), {}, dict(sizes)
    while left:
        level = total / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weights[s] for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
            del left[s]
    return out


def test_mix_meets_targets(docs):
    rows = [r.asDict() for r in mixing.mix_copies(docs).collect()]
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want = filled(sizes, weights, 1.5, 2.0)
    for s, size in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own)
    again = mixing.mix_copies(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["source"], r["copies"]) for r in again) == Counter((r["doc_id"], r["source"], r["copies"]) for r in rows)


def test_mix_repeats_rows(docs, none):
    copies = Counter()
    for r in mixing.mix_copies(docs).collect():
        copies[r["doc_id"], r["key"]] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["k"]) for r in out.select("doc_id", F.xxhash64("text").alias("k")).collect()) == +copies
    assert mixing.mix(none).count() == 0 and mixing.mix_copies(none).count() == 0


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], reach: int = 3) -> list[int]:
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_near_groups_equal_brute_force(spark, docs, none):
    rows = [r.asDict() for r in simhash.near_groups(docs).collect()]
    texts = Counter((r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in rows) == texts
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    tops = components([r["fp"] % 2**64 for r in rows])
    least = {t: min((r["doc_id"] for r, u in zip(rows, tops, strict=True) if u == t and r["doc_id"] is not None), default=None) for t in tops}
    assert all(r["component_id"] == least[t] for r, t in zip(rows, tops, strict=True))
    assert simhash.near_groups(none).count() == 0


def test_roots_have_themselves(spark):
    links = spark.createDataFrame([(9, 5), (7, 9), (2, 1)], "a long, b long")
    assert {tuple(r) for r in simhash.roots(links).collect()} == {(5, 5), (7, 5), (9, 5), (1, 1), (2, 1)}


def test_near_groups_whichever_fingerprint_is_less(spark):
    """Of two linked fingerprints one is the root; its document is in the group whether its doc_id is the smaller or the larger one."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    text, k = " ".join(words), 0
    while not 0 < (plain_fingerprint(text) ^ plain_fingerprint(other := " ".join([*words[:-1], f"x{k}"]))).bit_count() <= 3:
        k += 1
    for first, second in ((text, other), (other, text)):
        df = spark.createDataFrame([(3, first), (8, second)], "doc_id long, text string")
        assert {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(df).collect()} == {(3, 3), (8, 3)}


@pytest.mark.parametrize("limit", [2, 2048])
def test_links_of_crowded_fingerprints(spark, limit):
    """Groups over the limit are split again and lose nothing."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {r["node"] % 2**64: r["root"] for r in simhash.roots(simhash.near_links(spark, df, limit)).collect()}
    groups = defaultdict(set)
    for f, t in zip(fps, components(fps), strict=True):
        groups[t].add(f)
    ours = defaultdict(set)
    for f in fps:
        ours[found.get(f, simhash.signed(f))].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_components_keep_one_table(spark):
    """The links of earlier rounds went only when the driver ended, each with a file a partition."""
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = simhash.roots(links)
    assert len(set(os.listdir(folder)) - before) == 1 and {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(31)}


@pytest.mark.parametrize("limit, exchanges", [(100, 6), (1, 20)])
def test_links_are_planned_only_as_fine_as_groups_need(spark, limit, exchanges):
    """A plan with all levels at once, each derived anew from the one before, took the driver hundreds of MB to describe."""
    df = spark.createDataFrame([(i << 40,) for i in range(20)], "fp long")
    plan = simhash.near_links(spark, df, limit)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= exchanges


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 40))
def test_forest_joins_what_is_linked(seeds, extra):
    fps = list(dict.fromkeys(seeds + [s ^ (1 << (i % 64)) ^ (1 << (i * 7 % 64)) for i, s in enumerate(seeds * 2)][:extra]))
    a = np.array(fps, np.uint64)
    links = simhash.forest(a, np.bitwise_count(a[:, None] ^ simhash.pivots()[None, :]))
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for v, w in links:
        assert (fps[v] ^ fps[w]).bit_count() <= 3
        parent[max(top(v), top(w))] = min(top(v), top(w))
    assert [top(i) for i in range(len(fps))] == components(fps)


def test_near_keeps_one_a_group(docs, none):
    rows = simhash.near_groups(docs).collect()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fp = {(r["doc_id"], r["key"]): r["root"] for r in rows}
    got = [fp[r["doc_id"], r["k"]] for r in kept.select("doc_id", F.xxhash64("text").alias("k")).collect()]
    assert sorted(got) == sorted({r["root"] for r in rows})
    assert simhash.keep_one(none).count() == 0


def test_exact_groups(spark, docs, none):
    rows = exact.dedup_against(docs, exact.DigestIndex.temporary(spark)).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[hashlib.sha256((r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    assert Counter((r["doc_id"], r["digest"]) for r in rows) == Counter((d, k) for k, ds in want.items() for d in ds)
    for r in rows:
        top = max((d for d in want[r["digest"]] if d is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(want[r["digest"]]), r["doc_id"] == top)
    kept = exact.drop_duplicates(docs, exact.DigestIndex.temporary(spark))
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert exact.drop_duplicates(none, exact.DigestIndex.temporary(spark)).count() == 0


def test_index_keeps_what_it_has(spark):
    index = exact.DigestIndex.temporary(spark, 4)
    schema = "doc_id long, text string"
    first = exact.drop_duplicates(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema), index)
    assert sorted(r["doc_id"] for r in first.collect()) == [2, 3]
    second = exact.dedup_against(spark.createDataFrame([(9, "a"), (8, "c"), (2, "a")], schema), index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in second) == [(2, 2, False), (8, 8, True), (9, 2, False)]
    assert index.table().count() == 3


def test_whole_table_in_batches_equals_one_batch(spark, docs):
    index = exact.DigestIndex.temporary(spark, 4)
    assert Counter(exact.dedup_in_batches(docs, index, 3, "t").collect()) == Counter(exact.dedup_against(docs, exact.DigestIndex.temporary(spark)).collect())
    brought = {r["batch"]: r["count"] for r in index.table().groupBy("batch").count().collect()}
    assert sorted(brought) == ["t/range-0", "t/range-1", "t/range-2"] and sum(brought.values()) == index.table().select("digest").distinct().count()
    plan = index.unseen(docs.select(exact.digest(F.col("text")).alias("digest"), "doc_id"), "t/range-9")._jdf.queryExecution().executedPlan().toString()
    own, held = plan.split("SortMergeJoin")[1].split("Scan parquet", 1)
    assert "LeftAnti" in own and "Exchange" in plan and "Exchange" not in held  # the index side stays where it is


def test_tables_share_an_index(spark):
    """Two tables with the same ids: what the first brought is known to the second, and a table that comes again is unchanged."""
    index, schema = exact.DigestIndex.temporary(spark, 4), "doc_id long, text string"
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], schema)
    two = spark.createDataFrame([(1, "d"), (2, "c"), (3, "c"), (4, "z")], schema)
    kept = lambda df, name: {r["doc_id"]: r["kept"] for r in exact.dedup_in_batches(df, index, 2, name).collect()}
    assert kept(one, "one") == dict.fromkeys((1, 2, 3, 4), True)
    assert kept(two, "two") == {1: False, 2: False, 3: False, 4: True} == kept(two, "two")
    assert kept(one, "one") == dict.fromkeys((1, 2, 3, 4), True) and kept(two, None) == dict.fromkeys((1, 2, 3, 4), False)


def test_batch_again_after_a_lost_job(spark, docs):
    """The first run's result is never read; the second keeps the same rows, and so does one from a new table over the same files."""
    index = exact.DigestIndex.temporary(spark, 4)
    exact.drop_duplicates(docs, index, "monday")
    held = Counter(index.table().collect())
    again = exact.DigestIndex(spark, f"{index.name}_again", index.path, 4)
    index.drop()
    want = Counter(exact.drop_duplicates(docs, exact.DigestIndex.temporary(spark)).collect())
    assert Counter(exact.drop_duplicates(docs, again, "monday").collect()) == want and Counter(again.table().collect()) == held
    assert exact.drop_duplicates(docs, again, "tuesday").count() == 0


def spans(rows, docs, capacity, per_source):
    texts = [(r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in docs.collect()]
    want = Counter()
    for d, n in texts:
        for start in range(0, n, capacity):
            want[d, start, min(capacity, n - start)] += 1
        if not n:
            want[d, 0, 0] += 1
    assert Counter((r["doc_id"], r["start"], r["n_words"]) for r in rows) == want
    used = defaultdict(int)
    for r in rows:
        assert (r["bin_id"] is None) == (r["n_words"] == 0)
        used[r["bin_id"]] += r["n_words"]
    assert all(n <= capacity for b, n in used.items() if b) and all(r["bin_words"] == used[r["bin_id"]] for r in rows if r["bin_id"])


@pytest.mark.parametrize("per_source", [1, 2])
def test_packing(docs, none, per_source):
    rows = packing.pack(docs, 128, per_source, 16).collect()
    spans(rows, docs, 128, per_source)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bins = defaultdict(list)
    for r in rows:
        if r["bin_id"]:
            bins[r["bin_id"]].append(r["doc_id"])
    for held in bins.values():
        assert max(Counter(source[d] for d in held).values()) <= per_source
        assert max(Counter(text[d] for d in held).values()) == 1
    assert packing.pack(none).count() == 0


def test_packing_keeps_ids_whole(spark):
    """A null id beside ids no double can hold, and a thousand rows alike without an id."""
    rows = [(2**53 + 1, "a b c", "s"), (2**53 + 3, "a b", "s"), (None, "c", "s")] + [(None, "x y", "hot")] * 1000 + [(None, "long " * 50, "hot")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, 20, 2, 64).collect()
    assert {r["doc_id"] for r in out} == {2**53 + 1, 2**53 + 3, None}
    alike = [r["bin_id"] for r in out if r["doc_id"] is None and r["n_words"] == 2]
    assert len(alike) == len(set(alike)) == 1000
    per_shard = Counter(b.split("-")[0] for b in alike)
    assert len(per_shard) >= 10 and max(per_shard.values()) < 150
    assert len({r["bin_id"] for r in out if r["n_words"] == 20}) == 6
    again = packing.pack(df.repartition(5), 20, 2, 64).collect()
    assert Counter(again) == Counter(out)


def test_mix_of_rows_alike(spark):
    """Rows alike in everything take the ranks that stand next to each other, as single rows would."""
    rows = [(None, "x y", "hot")] * 900 + [(i, f"w{i} v", "hot") for i in range(100)] + [(5, "a b c", None)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix_copies(df, (1,), 1.3, 2.0).collect()
    hot = [r for r in out if r["source"] == "hot"]
    assert len(out) == len(rows) and abs(sum(r["copies"] * r["size"] for r in hot) - hot[0]["target"]) <= 2 and {r["copies"] for r in hot} == {1, 2}
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.mix(df, (1,), 1.3, 2.0).collect())
    assert taken[None, "x y"] == sum(r["copies"] for r in hot if r["doc_id"] is None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4), st.integers(-1, 3)), max_size=40), st.integers(1, 2))
def test_best_fit_takes_the_tightest_compatible_bin(pieces, per_source):
    got, bins = packing.best_fit(pieces, 20, per_source), []
    for (size, source, cluster), k in zip(pieces, got, strict=True):
        fits = [(20 - sum(p[0] for p in b) - size, i) for i, b in enumerate(bins) if sum(p[0] for p in b) + size <= 20 and sum(p[1] == source for p in b) < per_source and not (cluster >= 0 and any(p[2] == cluster for p in b))]
        assert k == (min(fits)[1] if fits else len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append((size, source, cluster))
