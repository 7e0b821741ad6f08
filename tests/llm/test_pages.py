"""op7: importance and pruning against a plain version, names that say nothing, and deep pages."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

from brasslark.llm import html
from tests.llm.conftest import SYLLABLES, prose

SCHEMA = "page_id long, url string, html string"


def site(seed: int, pages: int = 14) -> list[str]:
    """Pages of one site whose styles are random letters; some parts repeat, some vary, some are of one layout only."""
    rng = random.Random(seed)
    common = [prose(rng, SYLLABLES["bb"], 6) for _ in range(6)]
    out = []
    for i in range(pages):
        parts = [f'<div class="qa"><ul>{"".join(f"<li>{common[k]}</li>" for k in range(3))}</ul></div>']
        if i % 2:
            parts.append(f'<div class="qb"><div class="qc">{rng.choice(common)}</div>{common[4]}</div>')
        body = "".join(f"<p>{prose(rng, SYLLABLES['aa'], 12)}</p>" for _ in range(rng.randint(1, 4)))
        parts.append(f'<div class="qd"><h2>{prose(rng, SYLLABLES["aa"], 3)}</h2><div class="qe">{body}</div></div>')
        parts.append(f'<div class="qf{i}">{common[5]}<span> {rng.choice("xy")}</span></div>')
        if i % 3 == 0:
            rng.shuffle(parts)
        out.append(f"<html><body>{''.join(parts)}</body></html>")
    return out + out[:2]


def plain_tree(pages: list[str]) -> tuple[dict, dict, dict]:
    """content importance, presentation importance with arrangements, and (parent, depth, fixed, prior), by path."""
    seen, texts, arrangements, about = set(), defaultdict(list), defaultdict(Counter), {}
    m = Counter()
    for page in pages:
        blocks, nodes = html.parse(page)
        key = tuple((x.path, t) for x, t in blocks)
        if key in seen:
            continue
        seen.add(key)
        for x, t in blocks:
            texts[x.path].append((len(seen), t))
        for path in {x.path for x, _ in blocks}:
            m[path] += 1
        for x in nodes:
            about[x.path] = (x.parent, x.depth, x.tag in ("", "html", "body"), x.prior)
            if x.children:
                arrangements[x.path][tuple(x.children)] += 1

    def entropy(counts) -> float:
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts)

    content = {}
    for path, found in texts.items():
        by_text = defaultdict(Counter)
        for page, t in found:
            by_text[t][page] += 1
        mean = sum(entropy(c.values()) for c in by_text.values()) / len(by_text)
        content[path] = 1 - mean / math.log(m[path]) if m[path] > 1 else 1.0
    inner = {p: (entropy(c.values()) / math.log(sum(c.values())) if sum(c.values()) > 1 else 1.0, c) for p, c in arrangements.items()}
    return content, inner, about


def plain_dropped(content: dict, inner: dict, about: dict) -> set[int]:
    def weigh(v, prior):
        return v if prior is None else (1 - html.PRIOR) * v + html.PRIOR * prior

    def composite(path) -> float:
        values = [weigh(content[path], about[path][3])] if path in content else []
        if path in inner:
            shown, kinds = inner[path]
            total, own = sum(kinds.values()), html.GAMMA ** len(kinds)
            below = sum(k / total * sum(composite(c) for c in children) / len(children) for children, k in kinds.items())
            values.append(weigh((1 - own) * shown + own * below, about[path][3]))
        return max(values) if values else 1.0

    def gone(path) -> bool:
        parent, _, fixed, prior = about[path]
        return composite(path) < html.THRESHOLD and not fixed or prior is None and path != 0 and about[parent][3] is None and gone(parent)

    return {p for p in content if gone(p) or weigh(content[p], about[p][3]) < html.THRESHOLD}


@pytest.mark.parametrize("seed", [1, 2])
def test_importance_and_pruning_equal_a_plain_version(spark, seed):
    pages = site(seed)
    rows = html.parsed(spark.createDataFrame([(i, f"http://h.com/{i}", p) for i, p in enumerate(pages)], SCHEMA).repartition(3)).cache()
    content, inner, about = plain_tree(pages)
    found = html.measured(rows).collect()
    assert {r["path"]: pytest.approx(r["importance"], abs=1e-9) for r in found if r["leaf"]} == content
    assert {(r["path"], tuple(r["children"])): pytest.approx((r["importance"], r["share"]), abs=1e-9) for r in found if not r["leaf"]} == {
        (p, c): (shown, k / sum(kinds.values())) for p, (shown, kinds) in inner.items() for c, k in kinds.items()
    }
    want = plain_dropped(content, inner, about)
    assert {p for r in html.site_trees(rows).collect() for p in r["dropped"]} == want
    assert want and want < set(content)


def test_names_that_say_nothing(spark):
    """Neither article nor main, and classes of random letters: what repeats over the site goes, what varies stays."""
    rng = random.Random(8)
    menu = "".join(f"<li>{w}</li>" for w in prose(rng, SYLLABLES["bb"], 6).split())
    texts = [[prose(rng, SYLLABLES["aa"], 25) for _ in range(3)] for _ in range(20)]
    rows = [(i, f"http://h.com/{i}", f'<body><div class="x1"><ul class="kk">{menu}</ul></div><div class="zq"><div class="w">{"".join(f"<div>{p}</div>" for p in t)}</div></div><div class="vv"><div>All rights reserved</div></div></body>') for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "\n".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("body", ["has-sidebar", "no-sidebar", "with-nav", "post-with-comments", "page sidebar-right", "footer"])
def test_layout_names_above_the_article(spark, body):
    """Names of what a layout has don't make the article noise, on the body or on a wrapper; comments marked up as articles stay noise."""
    inner = '<article><h1>a b</h1><p>c d</p></article><section class="comments"><article><p>first!</p></article></section><aside class="x"><p>more</p></aside>'
    rows = [(1, "http://h.com/1", f'<html class="{body}"><body class="{body}">{inner}</body></html>'), (2, "http://g.com/1", f'<body><div class="{body}">{inner}</div></body>')]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "a b\nc d", 2: "a b\nc d"}


def test_repeated_text_of_an_article_stays(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><article><h1>t{i}</h1><p>own {i}</p><p>the same note</p></article></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"t{i}\nown {i}\nthe same note" for i in range(12)}


def test_deep_pages_take_memory_in_proportion(spark):
    peaks = []
    for n in (20_000, 100_000):
        tracemalloc.start()
        blocks, nodes = html.parse("<div>" * n + "deep" + "</li></div>" * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert [t for _, t in blocks] == ["deep"] and len(nodes) == n + 1
    assert peaks[1] < 7 * peaks[0] and peaks[1] < 200e6
    rows = [(1, "http://h.com/1", "<div>" * 100_000 + "deep"), (2, "http://h.com/2", "<p>" * 50_000 + "x"), (3, "http://h.com/3", "<ul>" + "<li>" * 50_000 + "y")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "deep", 2: "x", 3: "y"}


def test_formulas_are_text(spark):
    rows = [(1, "http://h.com/1", "<article><p>so <math><mi>a</mi><mo>+</mo><mn>1</mn></math> holds</p></article>")]
    assert html.extract(spark.createDataFrame(rows, SCHEMA)).first()["text"] == "so a+1 holds"
