"""Main text of web pages through a site style tree.

The DOMs of a host's pages are merged: nodes with the same path of styles (tag, class, id, role) are one node
of the host's tree. A content node's importance falls as its texts repeat over the host's pages (one minus the
mean entropy of its texts over pages); an inner node's presentation importance rises with the variety of its children's
arrangements, and its composite importance blends that with its children's. Branches below the threshold are removed
from every page of the host, and what is left is the text.

Where styles say what they are for, that is a prior blended into the measured importance: 0 for menus, headers, footers,
asides, adverts, notices, forms and comments, which may vary from page to page as much as articles do, 1 for the article
and the marks of running text in it, which may repeat. The share of pages on which a node stands outside of an article
that the page has lowers it too. All other nodes have the importance that is measured.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import saved
from brasslark.llm.urls import host_of

#: Importance below which a branch is removed.
THRESHOLD = 0.25
#: Decay of a node's own weight against its children's.
GAMMA = 0.9
#: Weight of what a style or the place outside of articles says against what is measured.
PRIOR = 0.8
#: Depth of the branches of a host's tree that are pruned apart: the children of the body.
BRANCH = 3
#: Parts into which a host's pages are dealt when they meet its tree.
SALTS = 64

#: What elements and styles are for.
SKIPPED = frozenset("script style noscript template head title svg iframe object embed canvas audio video map select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mtable mtr mtd mfenced mpadded mphantom menclose".split())
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("tr td th tbody thead tfoot", "table"), "tbody": ("tr td th tbody thead tfoot", "table"), "tfoot": ("tr td th tbody thead tfoot", "table"), "option": ("option", "select"),
}
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption section div main article body html header hgroup address details summary".split())
ARTICLE_TAGS, NOISE_TAGS = frozenset(("article", "main")), frozenset("nav footer aside header menu dialog form".split())
ARTICLE_STYLES = frozenset("article articlebody content maincontent main post postcontent postbody entry entrycontent story storybody".split())
NOISE_STYLES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header masthead menu modal "
    "nav navbar navigation newsletter notice notices notification alert pagination pager popup promo promotion related recommended respond rail share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toc toolbar topbar widget widgets reply replies discussion disclaimer complementary contentinfo search".split()
)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Parts of style names that speak of something the element has or lacks, not of what it is.
_OTHERS = re.compile(r"(?<![a-z])(has|with|without|no|is|hide|show)[-_]?(?=[a-z])[a-z]+")
#: Styles that stay noise even where they hold an article, since comments and teasers are marked up as articles too.
TEASERS = frozenset("comment comments reply replies discussion disqus respond related recommended promo promotion sponsor sponsored ad ads".split())


@lru_cache(1 << 16)
def style(tag: str, attributes: str) -> str:
    """The element's style: tag, then class, id and role; what follows the first digit of a name is folded, so numbered and generated names are one."""
    found = [f"{m[1].lower()}={' '.join(sorted(set(re.sub(r'[0-9].*', '0', w) for w in (m[2] or m[3] or m[4] or '').split())))}" for m in _ATTRIBUTE.finditer(attributes)] if "=" in attributes else []
    return re.sub(r"[>\s]+", " ", " ".join([re.sub("[0-9]+", "0", tag), *sorted(set(found))]))


def style_words(one: str) -> set[str]:
    return set(_PARTS.findall(_OTHERS.sub(" ", re.sub(r"\b(class|id|role)=", " ", one.partition(" ")[2]).lower())))


@lru_cache(1 << 16)
def purpose(one: str) -> str:
    """noise, teaser (noise whatever it holds), heading, article, or running for marks of text without a style of their own; else open.

    The document and its body are open, whatever they are called.
    """
    tag, _, rest = one.partition(" ")
    words = style_words(one)
    if tag in ("html", "body"):
        return "open"
    if tag == "header" or words & NOISE_STYLES == {"header"} and tag not in NOISE_TAGS:
        return "heading"
    if tag in NOISE_TAGS and tag != "form" or words & TEASERS:
        return "teaser"
    if tag == "form" or words & NOISE_STYLES:
        return "noise"
    if tag in ARTICLE_TAGS or words & ARTICLE_STYLES or {"article", "main"} & words:
        return "article"
    return "running" if tag in RUNNING and not rest else "open"


class Node:
    """A node of the page's tree of styles: all elements with one path. Paths are hashes, chained from parent to child, so depth costs nothing."""

    __slots__ = ("path", "parent", "branch", "depth", "tag", "style", "hard", "soft", "inside", "since", "children", "prior")

    def __init__(self, above: Node | None, tag: str = "", own: str = ""):
        """hard, soft: under noise that nothing or an article below it excuses; inside: in an article; since: in an open node of it."""
        self.tag, self.style, self.children = tag, own, {}
        if above is None:
            self.path = self.parent = self.branch = self.depth = 0
            self.hard = self.soft = self.inside = self.since = False
        else:
            self.path = xxhash.xxh64_intdigest(own, above.path & (1 << 64) - 1) - (1 << 63)
            self.parent, self.depth = above.path, above.depth + 1
            self.branch = above.branch if self.depth > BRANCH else self.path
            kind = purpose(own)
            self.hard = above.hard or kind == "teaser"
            self.soft, self.inside, self.since = above.soft, above.inside, above.since
            if kind == "article":
                self.soft, self.inside, self.since = False, True, False
            elif kind == "noise" or kind == "heading" and not above.inside:
                if above.inside:
                    self.hard = True
                else:
                    self.soft = True
            elif kind == "open":
                self.since = True
        #: 0 for noise, 1 for the article and running text in it, else None: to be measured.
        self.prior = 0.0 if self.hard or self.soft else 1.0 if self.inside and not self.since else None


def parse(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(node, text) of the page's blocks in order, and the page's nodes, each with its children's paths in order of first appearance.

    Character references are decoded, white space inside a block is one space, empty blocks are left out. Tags that
    are not closed are closed where HTML closes them.
    """
    root = Node(None)
    nodes: dict[int, Node] = {0: root}
    stack: list[Node] = [root]
    open_tags: Counter[str] = Counter()
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    at, n, low = 0, len(html), html.lower()
    if len(low) != n:  # lower() may change the length of rare letters
        low = re.sub("[A-Z]", lambda m: m[0].lower(), html)

    def end_block() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((stack[-1], text))

    def close(upto: int) -> None:
        end_block()
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
        del stack[upto:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            run.append(html[at:])
            break
        if lt > at:
            run.append(html[at:lt])
        if low.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if low.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if not m:
            if html[lt + 1 : lt + 2].isalpha() or html[lt + 1 : lt + 2] == "/":  # a tag that never ends
                break
            run.append("<")
            at = lt + 1
            continue
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if tag == "br" or tag == "hr" or (tag in VOID and tag in INLINE):
            run.append(" ")
            if tag == "hr":
                end_block()
            continue
        if tag in VOID:
            continue
        if slash:
            if tag in INLINE or tag in SKIPPED:
                continue
            if not open_tags[tag]:
                end_block()
                continue
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            close(k)
            continue
        if tag in SKIPPED and not attributes.rstrip().endswith("/"):
            end_block()
            end = low.find(f"</{tag}", at)
            if tag == "head" and end < 0:  # not closed: it ends where the body begins
                end = low.find("<body", at)
                at = n if end < 0 else end
            elif end < 0:
                at = n
            else:
                gt = html.find(">", end)
                at = n if gt < 0 else gt + 1
            continue
        if tag in INLINE or tag in SKIPPED:
            continue
        end_block()
        if tag in CLOSES:
            shut, within = (x.split() for x in CLOSES[tag])
            k, left = len(stack) - 1, sum(open_tags[t] for t in shut)
            while k > 0 and left and stack[k].tag not in within:
                if stack[k].tag in shut:
                    left -= 1
                    close(k)
                k -= 1
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        above = stack[-1]
        own = Node(above, tag, style(tag, attributes))
        own = nodes.setdefault(own.path, own)
        above.children[own.path] = None
        if not attributes.rstrip().endswith("/"):
            stack.append(own)
            open_tags[tag] += 1
    end_block()
    return blocks, list(nodes.values())


_BLOCK = "array<struct<path: long, branch: long, text: string, outside: boolean>>"
_NODE = "array<struct<path: long, parent: long, branch: long, depth: int, prior: double, fixed: boolean, arrangement: long, children: array<long>>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks (path, branch, text, outside), nodes (path, parent, branch, depth, prior, fixed, arrangement, children) per row of pages.

    A page without host is its own site. outside: the page has an article, and the block is not in it. fixed: no
    branch, but the document or its body. arrangement: hash of the children's paths in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            pa.list_(pa.struct([("path", pa.int64()), ("branch", pa.int64()), ("text", pa.string()), ("outside", pa.bool_())])),
            pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("branch", pa.int64()), ("depth", pa.int32()), ("prior", pa.float64()), ("fixed", pa.bool_()), ("arrangement", pa.int64()), ("children", pa.list_(pa.int64()))])),
        ]
        for b in batches:
            blocks, inner = [], []
            for html in b.column("html").to_pylist():
                own, nodes = parse(html or "")
                some = any(x.inside for x, _ in own)
                blocks.append([{"path": x.path, "branch": x.branch, "text": t, "outside": some and not x.inside} for x, t in own])
                inner.append([{
                    "path": x.path, "parent": x.parent, "branch": x.branch, "depth": x.depth, "prior": x.prior, "fixed": x.tag in ("", "html", "body"),
                    "arrangement": xxhash.xxh64_intdigest(",".join(map(str, x.children))) - (1 << 63) if x.children else None, "children": list(x.children),
                } for x in nodes])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), pa.array(blocks, kinds[0]), pa.array(inner, kinds[1])], ["page_id", "url", "host", "blocks", "nodes"])

    url = F.col("url").cast("string")
    host = F.when(host_of(url) != "", host_of(url)).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")), F.lit(" "), F.coalesce(F.xxhash64("html").cast("string"), F.lit(""))))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id long, url string, host string, blocks {_BLOCK}, nodes {_NODE}")


def entropy(rows: DataFrame, node: list[str], of: str) -> DataFrame:
    """(node, nats): mean over the node's distinct `of` values of their entropies over pages.

    Counts are added up before anything meets: a hot host's rows never come together.
    """
    each = rows.groupBy(*node, of, "page").agg(F.count(F.lit(1)).alias("c"))
    per = each.groupBy(*node, of).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.log("c")).alias("e"))
    return per.groupBy(*node).agg(F.avg(F.log("s") - F.col("e") / F.col("s")).alias("nats"))


def measured(rows: DataFrame) -> DataFrame:
    """The nodes of all hosts' trees: host, branch, path, parent, depth, prior, fixed; leaf rows with content importance and the share of
    blocks outside of articles, inner rows, one an arrangement, with presentation importance, the arrangement's share and its children.

    Pages alike in all blocks count once.
    """
    features = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["branch"].alias("branch"), F.xxhash64(b["text"]).alias("feature"), b["outside"].alias("outside")))  # texts stay where they are
    texts = F.xxhash64(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["text"].alias("text"))))
    pages = rows.select("host", texts.alias("page"), features.alias("blocks"), "nodes").dropDuplicates(["host", "page"])
    blocks = pages.select("host", "page", F.inline("blocks"))
    inner = pages.select("host", "page", F.inline("nodes"))
    node = ["host", "branch", "path"]
    on_pages = blocks.groupBy(*node, "page").agg(F.avg(F.col("outside").cast("double")).alias("o")).groupBy(*node).agg(F.count(F.lit(1)).alias("m"), F.avg("o").alias("outside"))
    content = entropy(blocks, node, "feature").join(on_pages, node)
    content = content.select(*node, F.when(F.col("m") > 1, 1 - F.col("nats") / F.log("m")).otherwise(1.0).alias("importance"), "outside")
    known = ["parent", "depth", "prior", "fixed"]
    kinds = inner.groupBy(*node, *known, "arrangement").agg(F.count(F.lit(1)).alias("k"), F.first("children").alias("children"))
    leaves = content.join(kinds.select(*node, *known).distinct(), node).select(*node, *known, F.lit(True).alias("leaf"), "importance", "outside", F.lit(None).cast("double").alias("share"), F.lit(None).cast("array<long>").alias("children"))
    totals = kinds.where("arrangement is not null").groupBy(*node).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("e"))
    shown = F.when(F.col("m") > 1, (F.log("m") - F.col("e") / F.col("m")) / F.log("m")).otherwise(1.0)
    presentation = kinds.where("arrangement is not null").join(totals, node)
    presentation = presentation.select(*node, *known, F.lit(False).alias("leaf"), shown.alias("importance"), F.lit(0.0).alias("outside"), (F.col("k") / F.col("m")).alias("share"), "children")
    return leaves.union(presentation)


def site_trees(rows: DataFrame) -> DataFrame:
    """(host, dropped): the paths of each host's tree whose blocks are to be removed; hosts without such paths are left out.

    Everything is summed up by (host, path) before the nodes of a branch, which are as many as its distinct
    styles, meet in one task.
    """
    pruned = measured(rows).groupBy("host", "branch").applyInPandas(prune, "host string, dropped array<long>")
    return pruned.where(F.size("dropped") > 0).groupBy("host").agg(F.flatten(F.collect_list("dropped")).alias("dropped"))


def blend(value: float, prior: float | None, outside: float) -> float:
    """Importance of a node from what is measured, what its styles say, and how often it stands outside of articles."""
    if prior is not None:
        return (1 - PRIOR) * value + PRIOR * prior
    return value * (1 - PRIOR * outside)


def prune(nodes: pd.DataFrame) -> pd.DataFrame:
    """The paths of one branch of a host's tree to be removed; nodes: rows of `measured`.

    A node's composite importance is known once its children's is, so the deepest come first. A branch below the
    threshold goes with all that is measured in it; the document and its body are no branches.
    """
    content: dict[int, float] = {}
    about: dict[int, tuple[int, int, float | None, bool]] = {}
    inner: dict[int, tuple[float, list[tuple[float, list[int]]]]] = {}
    for r in nodes.itertuples(index=False):
        prior = None if pd.isna(r.prior) else float(r.prior)
        about[r.path] = (int(r.depth), r.parent, prior, bool(r.fixed))
        if r.leaf:
            content[r.path] = blend(r.importance, prior, r.outside)
        else:
            inner.setdefault(r.path, (r.importance, []))[1].append((r.share, list(r.children)))

    composite: dict[int, float] = {}
    for path in sorted(about, key=lambda p: (-about[p][0], p)):
        values = [content[path]] if path in content else []
        if path in inner:
            shown, kinds = inner[path]
            below = sum(share * sum(composite.get(c, 1.0) for c in children) / len(children) for share, children in kinds)
            own = GAMMA ** len(kinds)
            values.append(blend((1 - own) * shown + own * below, about[path][2], 0.0))
        composite[path] = max(values)

    gone: set[int] = set()
    dropped = []
    for path in sorted(about, key=lambda p: (about[p][0], p)):
        _, parent, prior, fixed = about[path]
        if composite[path] < THRESHOLD and not fixed or prior is None and parent in gone and about[parent][2] is None:
            gone.add(path)
        if path in content and (path in gone or content[path] < THRESHOLD):
            dropped.append(path)
    return pd.DataFrame({"host": [nodes["host"].iloc[0]], "dropped": [sorted(dropped)]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html): the main text, its blocks joined by line feeds.

    A null html is empty. Repeated rows are separate rows; they count once in their host's tree. A host's removed
    paths meet its pages dealt into SALTS parts; the planner broadcasts them only if their written size allows it.
    """
    rows = saved(parsed(pages), "blocks")
    trees = saved(site_trees(rows), "trees")
    salted = trees.select(F.col("host").alias("of"), "dropped", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("page_id", "url", "blocks"), F.lit(SALTS)).cast("int")
    joined = rows.select("page_id", "url", "host", "blocks", part.alias("salt")).join(salted, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
    gone = F.array_intersect(F.transform("blocks", lambda b: b["path"]), F.coalesce("dropped", F.array().cast("array<long>")))
    joined = joined.select("page_id", "url", "blocks", gone.alias("gone"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~F.array_contains("gone", b["path"])), lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
