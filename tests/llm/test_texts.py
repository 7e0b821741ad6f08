"""op2, op3, op5, op7, op9, op10: classifiers, URLs, pages, fingerprints."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasslark.llm import html, langid, minhash, quality, toxicity, urls
from brasslark.llm.common import held_out
from tests.llm.conftest import SYLLABLES, prose


def test_language_of_held_out_documents(spark, docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    plain = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 60 and r["held_out"]]
    assert plain and np.mean([r["lang_pred"] == lang[r["doc_id"]][0] for r in plain]) >= 0.9
    for r in rows:
        text = lang[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_ignores_what_it_may_not_read(docs):
    a = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    hidden = docs.withColumn("lang", F.when(held_out(F.col("doc_id"), 4, 2), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(hidden).collect()} == a


def test_bundle_is_the_sum_of_bound_grams():
    binder = langid.Binder(64, 3)
    keys, counts = langid.grams("Abcabc d")
    letters = {c: binder.letter(ord(c)).astype(int) for c in "abcd "}
    text, want = " abcabc d ", np.zeros(64)
    for i in range(len(text) - 2):
        want += letters[text[i]] * np.roll(letters[text[i + 1]], 1) * np.roll(letters[text[i + 2]], 2)
    assert (binder.bundle(keys, counts) == want).all()


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text, toxic, good = prose(rng, SYLLABLES["aa"], rng.randint(5, 60)), i % 5 == 0, i % 4 > 0
        words = text.split()
        if i % 3 == 0:
            words.insert(rng.randint(0, len(words)), "women" if not toxic or i % 2 else "men")
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["rotten", "vile"]))
        text = " ".join(words) if good else " | ".join(words)
        rows.append((i, text))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "vile"), (n + 2, "vile " + "x " * 20000), (n + 2, "vile " + "x " * 20000)]
    labels += [(None, 1, 1), (9, None, None), (0, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(3)).withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark, none):
    docs, labels = labelled(spark)
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in own]) >= 0.95
    assert all(r["predicted"] == 1 for r in rows if r["doc_id"] is None or r["doc_id"] == 402)
    assert toxicity.judge(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.judge(docs, labels.where("toxic = 0")).collect()} == {0}


def test_counterfactuals_protect_group_names(spark):
    """Labels in which one group is named in toxic texts only: the penalty takes the weight off the name."""
    rng = random.Random(2)
    rows = [(i, prose(rng, SYLLABLES["aa"], 12) + (" rotten muslims here" if i % 8 == 0 else " muslims here" if i % 8 == 1 and i % 3 else " rotten" if i % 8 == 2 else ""), int(i % 8 in (0, 2) or (i % 8 == 1 and i % 3 > 0 and i % 5 > 0))) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    free, bound = (toxicity.fit(docs, labels, counterfactual=w) for w in (0.0, 50.0))
    neutral = "a group of muslims here"
    assert bound.score(neutral) < free.score(neutral) and bound.score("rotten") > 0.5
    assert abs(bound.score(neutral) - bound.score("a group of christians here")) < abs(free.score(neutral) - free.score("a group of christians here"))


def test_swaps_stay_in_their_group():
    pairs = toxicity.rewritten("No name. The old Women spoke. End")
    assert len(pairs) == toxicity.SWAPS and all(a == " the old women spoke" and b != a and len(b.split()) == 4 for a, b in pairs)
    assert toxicity.rewritten("") == []
    assert len(toxicity.rewritten("the women came. " * 50)) == 50 * toxicity.SWAPS
    assert {b.split()[-1] for _, b in toxicity.rewritten("alle Flüchtlinge")} <= set(toxicity.GROUP_OF["flüchtlinge"])


def test_groups_are_mined_from_labelled_texts(spark):
    """Words that toxic texts have more often, though most that have them are neutral; not the words that make a text toxic."""
    rng = random.Random(9)
    rows = []
    for i in range(800):
        toxic, words = i % 8 == 0, prose(rng, SYLLABLES["cc"], 10).split()
        if toxic and rng.random() < 0.5 or rng.random() < 0.12:
            words += [rng.choice(["those", "some"]), rng.choice(["zorbs", "glims"]), rng.choice(["there", "again"])]
        if toxic:
            words.append("vile")
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    groups = toxicity.mined_groups(df, 800, 100)
    assert {"zorbs", "glims"} <= set(groups) and "vile" not in groups
    assert all(t in g and len(g) > 1 for t, g in groups.items())
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", F.col("label").alias("toxic")))
    assert model.pairs > 0
    assert sorted(toxicity.slots("Hi. those zorbs; zorbs", frozenset(["zorbs"]))) == [("zorbs", "those _ zorbs"), ("zorbs", "zorbs _ ")]


def test_labels_that_no_word_tells_give_no_terms(spark):
    """Permuted labels, over and over: a bound over all words tested leaves chance words out."""
    rng = random.Random(10)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(1500)], k=60)) for _ in range(1500)]
    found = 0
    for _ in range(3):
        labels = [1] * 180 + [0] * 1320
        rng.shuffle(labels)
        df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, label int").coalesce(2)
        found += len(toxicity.mined_groups(df, 1500, 180))
    assert found == 0


def test_false_alarms_by_group_on_held_out_mentions(spark):
    """Toxic texts name one group more than another. With the penalty, neutral mentions of both are flagged alike, and toxic ones are found as before."""
    rng, rows, about = random.Random(11), [], {}
    for i in range(2400):
        group, toxic = rng.choice(["immigrants", "citizens"]), False
        bad = rng.random() < (0.5 if group == "immigrants" else 0.05)
        words = prose(rng, SYLLABLES["aa"], 12) + f". many {group} came"
        if bad:
            toxic = rng.random() < 0.9
            words += rng.choice([" vile", " rotten"]) if rng.random() < 0.3 else ""
        rows.append((i, words, int(toxic)))
        about[i] = (group, toxic, "vile" in words or "rotten" in words)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    rates = {}
    for weight in (0.0, 50.0):
        out = [r for r in toxicity.judge(docs, labels, counterfactual=weight).collect() if r["held_out"]]
        neutral = {g: [r["predicted"] for r in out if about[r["doc_id"]] [0] == g and not about[r["doc_id"]][1]] for g in ("immigrants", "citizens")}
        told = [r["predicted"] for r in out if about[r["doc_id"]][2]]
        rates[weight] = {g: sum(x) / len(x) for g, x in neutral.items()} | {"told": sum(told) / len(told)}
    assert rates[0.0]["immigrants"] > 0.5 > 0.1 > rates[0.0]["citizens"]
    assert rates[50.0]["immigrants"] < 0.1 and rates[50.0]["citizens"] < 0.1 and rates[50.0]["told"] > 0.9


def test_drawn_pairs_weigh_as_all_do(spark):
    docs = spark.createDataFrame([(i, f"the women are {w} here. ok" if i % 2 else f"{w} men") for i, w in enumerate(["vile", "kind", "new", "old"] * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    every, few = (toxicity.fit(docs, labels, pairs_each=k) for k in (100.0, 1e-4))
    assert every.pairs == few.pairs > 0


def test_telling_buckets_equal_the_plain_ones():
    rng = random.Random(3)
    texts = [prose(rng, SYLLABLES["aa"], rng.randint(0, 30)) + " Rotten rottenness" for _ in range(40)]
    every = np.unique(np.concatenate([toxicity.buckets(t) for t in texts]))
    columns = np.sort(np.array(rng.sample(every.tolist(), len(every) // 2), np.int32))
    telling = toxicity.Telling(columns)
    assert [telling.of(t) for t in texts] == [np.intersect1d(toxicity.buckets(t), columns).astype(np.int32).tobytes() for t in texts]


def plain_descent(x, y, before, after, l1, l2, weight, steps=60_000, rate=0.3):
    """Proximal gradient with a fixed step over dense rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    s = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        r = (s(x @ w + b) - y) / len(y)
        p, q = s(before @ w + b), s(after @ w + b)
        c = 2 * weight / len(before) * (p - q)
        w = w - rate * (x.T @ r + before.T @ (c * p * (1 - p)) - after.T @ (c * q * (1 - q)) + l2 * w)
        b -= rate * (r.sum() + (c * (p * (1 - p) - q * (1 - q))).sum())
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


@pytest.mark.parametrize("l1, l2", [(0.01, 0.0), (0.0, 0.05)])
def test_descent_reaches_the_optimum_of_a_plain_one(l1, l2):
    rng = np.random.default_rng(4)
    x, before, after = (rng.random((n, 8)) < 0.4 for n in (80, 20, 20))
    y = (rng.random(80) < 0.2 + 0.6 * x[:, 0]).astype(float)
    after[:, 1:] = before[:, 1:]
    rows = lambda m: toxicity.Rows([np.flatnonzero(r).astype(np.int32) for r in m], np.arange(8, dtype=np.int32))
    w, b = toxicity.descend(rows(x), y, rows(before), rows(after), l1, l2, 4.0, 2000)
    want, bias = plain_descent(x.astype(float), y, before.astype(float), after.astype(float), l1, l2, 4.0)
    assert np.abs(w - want).max() < 2e-2 and abs(b - bias) < 2e-2
    free, _ = toxicity.descend(rows(x), y, rows(before), rows(after), l1, l2, 0.0, 2000)
    assert abs(w[0]) < 0.8 * abs(free[0])


def test_quality_on_held_out_documents(spark, none):
    docs, labels = labelled(spark)
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in own]) >= 0.9
    assert quality.judge(none, labels).count() == 0
    assert {r["score"] for r in quality.judge(docs, labels.where("quality = 9")).collect()} == {0.5}


def test_word_vectors_equal_a_plain_sum(spark):
    texts = ["a b c a", "c", None, "", "b b"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    places, signs = quality.index_vectors()
    hasher, want = quality.Hasher(), np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        ids = hasher.ids(t or "")
        for i in range(len(ids)):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(want[ids[i]], places[ids[j]], signs[ids[j]])
    assert (got == want).all()


def test_temperature_and_layers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y, epochs=150, rate=1e-2)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.9 and 0.25 <= net.temperature <= 8


URLS = [
    ("http://A.net/x", "a.net", "/x", "net/", "block"), ("https://example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://m.example.com/de/1?q=/", "m.example.com", "/de/1", "example.com/de/", "block"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://xorg/fr/", "xorg", "/fr/", None, None), ("http://a.net?x", "a.net", "", None, None),
    ("http://org#/fr/", "org", "", None, None), ("a.net/x", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://y://net/", "y:", "//net/", None, None), ("http://ÄB.org/\n/z", "Äb.org", "/\n/z", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] == (verdict or "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam-pills' if i % 4 == 0 else 'good'}.site{i % 3}.com/{'buy' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + [(7, rows[7][1])], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400) if i % 3] + [(None, True)], "page_id long, bad boolean")
    got = urls.judge(pages, labels)
    assert got.count() == 401 and all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in got.collect())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><nav><ul><li><a href="/">Home</a></ul></nav><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><form action="/all"><article><div class="post-header"><h1>Head &amp; line</h1></div><p>One<b> two</b>
 three &lt;x&gt;<p>Four<br>five<script>var a="</p>";</script><ul><li>item 1<li>item 2</ul><form><input>Mail<button>Go</button></form><div class="comments"><p>me too</p></div><footer>By me</footer></article></form>
<aside>More</aside><section id="comments"><p>first!</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", None), (3, None, "<p>a&nbsp;b &#228; &am <p>c"), (4, "bad url", "plain  text"), (5, "http://a.com/5", ""), (1, "http://a.com/1", PAGE), (6, "http://b.com", "<div>x<!-- no --><p>y</p>z</div><p unclosed")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    main = "Head & line\nOne two three <x>\nFour five\nitem 1\nitem 2"
    want = {1: main, 2: "", 3: "a b ä &am\nc", 4: "plain text", 5: "", 6: "x\ny\nz"}
    assert got == sorted((i, want[i], len(want[i])) for i, _, _ in rows)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_branches_are_removed(spark):
    """No style says what the block is; it repeats on every page of the host and goes, while the text stays."""
    rng = random.Random(4)
    texts = [prose(rng, SYLLABLES["aa"], 30) for _ in range(12)]
    rows = [(i, f"http://h.com/{i}", f'<body><div class="zz">Terms apply. All rights reserved.</div><div class="yy"><p>{t}</p></div></body>') for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts))


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, "http://h.com/x", "<article><h1>a</h1><p>same words</p></article>") for i in range(30)]
    assert {r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"a\nsame words"}


def plain_edit(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


@pytest.mark.parametrize("parts", [1, 4])
def test_edits_and_neighbours(spark, docs, parts):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    rows = list({r["doc_id"]: r for r in rows}.values())
    rows.sort(key=lambda r: r["doc_id"])
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").withColumn("part", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in minhash.with_next(df, parts).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        new, g = plain_edit(text, following), got[r["doc_id"]]
        a, b, c = (minhash.signature(x) for x in (text, new, following))
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (g["fingerprint"], g["edited_fingerprint"]) == (minhash.text_of(a), minhash.text_of(b))
        assert (g["near_edited"], g["near_next"]) == (minhash.likeness(a, b), minhash.likeness(a, c))


def test_signature_edges(spark):
    assert minhash.likeness(minhash.signature(""), minhash.signature("a")) < 0.2
    assert minhash.likeness(minhash.signature("ab" * 50), minhash.signature("ab" * 50)) == 1
    assert minhash.likeness(minhash.signature("ab" * 50), minhash.signature("ab" * 500)) < 0.9
    one = minhash.with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert minhash.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = minhash.with_next(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "b")], "doc_id long, text string"), 3).collect()
    assert len(twice) == 4
    same = minhash.fingerprint(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert same[0]["fingerprint"] == same[1]["fingerprint"]


def test_signature_equals_a_plain_order_minhash():
    """The signature hashes, for each function, the least k-mers in their order in the text."""
    rng = random.Random(6)
    text = prose(rng, SYLLABLES["aa"], 40)
    words = minhash.numbered_kmers(np.array([ord(c) for c in text], np.uint64))
    a, b = minhash.functions()
    got = minhash.signature(text)
    for r in range(minhash.ROWS):
        h = [((int(w) >> 32) ^ int(b[r])) * int(a[r]) % 2**32 for w in words]
        chosen = sorted(sorted(range(len(h)), key=lambda i: (h[i], i))[: minhash.TUPLE])
        out = minhash.mixed(a[r : r + 1].astype(np.uint64))
        for i in chosen:
            out = minhash.mixed(out + words[i : i + 1])
        assert int(out[0]) & 0xFFFF == got[r]
    assert len(set(words.tolist())) == len(words)


def test_order_matters():
    rng = random.Random(7)
    parts = [prose(rng, SYLLABLES["bb"], 30) for _ in range(4)]
    straight, turned = " ".join(parts), " ".join(parts[::-1])
    edited = straight[:-40] + "y" * 40
    near, far = (minhash.likeness(minhash.signature(straight), minhash.signature(x)) for x in (edited, turned))
    assert near > far
