"""Filings to sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructType

from brasslark.functions.text import digit_ratio

#: The items of a yearly filing, those with content, and headings of filings that do not number them.
ITEM_TITLES = {
    "1": "Business", "1A": "Risk Factors", "1B": "Unresolved Staff Comments", "1C": "Cybersecurity", "2": "Properties", "3": "Legal Proceedings", "4": "Mine Safety Disclosures",
    "5": "Market for Registrant", "6": "Selected Financial Data", "7": "Management's Discussion and Analysis", "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data", "9": "Changes in and Disagreements with Accountants", "9A": "Controls and Procedures", "9B": "Other Information",
    "10": "Directors, Executive Officers and Corporate Governance", "11": "Executive Compensation", "12": "Security Ownership", "13": "Certain Relationships and Related Transactions",
    "14": "Principal Accountant Fees and Services", "15": "Exhibits, Financial Statement Schedules",
}
CONTENT_ITEMS = ("0", "1", "1A", "1C", "3", "5", "7", "7A", "8", "15")
HEADINGS = {"1A": r"risk\s+factors", "1C": "cybersecurity", "3": r"legal\s+proceedings", "7": r"management['’]?s\s+discussion\s+and\s+analysis", "7A": r"quantitative\s+and\s+qualitative\s+disclosures?\s+about\s+market\s+risk", "8": r"financial\s+statements\s+and\s+supplementary\s+data"}
GRAPH_ITEMS = ("0", "1", "1A", "7", "3")
#: Words that point at relations between companies, and at the structure of a business.
RELATION_CUES = (
    r"(?i)\b(compet\w*|rival|supplier|supplied|suppl\w+|foundr\w+|manufactur\w+ (for|by)|customer|purchas\w+ from|rely on|relies on|reliant|depend\w* on|sole source|single source|partner\w*"
    r"|collaborat\w+|joint venture|acquir\w+|acquisition|subsidiar\w+|merger|licens\w+ from|outsourc\w+)\b"
)
STRUCTURE_CUES = r"(?i)\b(reportable segment|operating segment|our segments|business segment|product line|we (offer|sell|design|develop))\b"

#: Texts that are held as Python's strings at once; it bears on memory only.
FEW = 64

_BLOCKS = frozenset("p div br tr table li ul ol h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr nav".split())


class _Text(HTMLParser):
    """Text with one line a block and table rows as cells with bars between."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.cells = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag == "tr":
            self.out.append("\n")
            self.cells.append(0)
        elif tag in ("td", "th"):
            if self.cells and self.cells[-1]:
                self.out.append(" | ")
            if self.cells:
                self.cells[-1] += 1
        elif tag in _BLOCKS and not self.cells:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "tr" and self.cells:
            self.cells.pop()
            self.out.append("\n")
        elif tag in _BLOCKS and not self.cells:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def page_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(r"[  ]+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


@arrow_udf(StringType())
def html_to_text(html: pa.Array) -> pa.Array:
    """Readable text of a page; NULL gives an empty text. Only few pages at once are Python's strings."""
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([page_text(t.as_py()) for t in html.slice(at, FEW)], pa.string()) for at in range(0, len(html), FEW))])


def _plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def item_anchors(text: str | None) -> list[dict]:
    """item, at, confirmed of every numbered heading: at a line's start, a bar allowed before it, confirmed if its title follows."""
    out = []
    for m in re.finditer(r"(?im)^[ \t|]*item[\s |]+(\d{1,2}[abc]?)\b[\s.:|\-–—]*", text or ""):
        item = m[1].upper()
        if item in ITEM_TITLES:
            title = _plain(ITEM_TITLES[item])[:16]
            out.append({"item": item, "at": m.start(), "confirmed": title in _plain(text[m.start() : m.start() + 260])})
    return out


def heading_anchors(text: str | None) -> list[dict]:
    """item, at, confirmed of every descriptive heading alone on its line."""
    out = [{"item": item, "at": m.start(), "confirmed": True} for item, p in HEADINGS.items() for m in re.finditer(rf"(?im)^[ \t|]*{p}[ \t.:|]*$", text or "")]
    return sorted(out, key=lambda a: a["at"])


ANCHORS = ArrayType(StructType().add("item", "string").add("at", "integer").add("confirmed", "boolean"))


@pandas_udf(ANCHORS)
def items_of(text: pd.Series) -> pd.Series:
    return text.map(item_anchors)


@pandas_udf(ANCHORS)
def headings_of(text: pd.Series) -> pd.Series:
    return text.map(heading_anchors)


def split_at(docs: DataFrame, anchors, gap: int) -> DataFrame:
    """doc_id, item, start, end: per item the anchor with the longest way to the next; ways under `gap` are tables of contents. Confirmed anchors only, where there are any."""
    a = docs.select("doc_id", F.length("text").alias("n"), F.explode(anchors).alias("a")).select("doc_id", "n", "a.item", "a.at", "a.confirmed")
    doc = Window.partitionBy("doc_id")
    a = a.withColumn("any", F.max(F.col("confirmed").cast("int")).over(doc)).where((F.col("any") == 0) | F.col("confirmed"))
    a = a.withColumn("way", F.lead("at").over(doc.orderBy("at"))).withColumn("way", F.coalesce("way", "n") - F.col("at"))
    best = a.where(F.col("way") >= gap).groupBy("doc_id", "item").agg(F.max_by("at", F.struct("way", -F.col("at"))).alias("start"), F.first("n").alias("n"))
    return best.withColumn("end", F.coalesce(F.lead("start").over(doc.orderBy("start")), "n")).drop("n")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, item, title, text, strategy (items, headings, whole) of docs (doc_id, text).

    Numbered items first; descriptive headings where those give fewer than 3 content items and headings give more;
    else a text of over 5000 signs is one section "0".
    """
    content = F.col("item").isin(*CONTENT_ITEMS)
    a = split_at(docs, items_of("text"), 400).withColumn("strategy", F.lit("items"))
    b = split_at(docs, headings_of("text"), 2000).withColumn("strategy", F.lit("headings"))
    n = lambda df, c: df.groupBy("doc_id").agg(F.count_if(content).alias(c))
    choice = docs.select("doc_id", F.length("text").alias("n")).join(n(a, "na"), "doc_id", "left").join(n(b, "nb"), "doc_id", "left").na.fill(0, ["na", "nb"])
    use = F.when((F.col("na") < 3) & (F.col("nb") > F.col("na")), "headings").when(F.col("na") > 0, "items").when(F.col("n") > 5000, "whole")
    choice = choice.select("doc_id", "n", use.alias("use"))
    cut = a.unionByName(b).join(choice, "doc_id").where("strategy = use").select("doc_id", "item", "start", "end", "strategy")
    whole = choice.where("use = 'whole'").select("doc_id", F.lit("0").alias("item"), F.lit(0).alias("start"), F.col("n").alias("end"), F.lit("whole").alias("strategy"))
    titles = F.create_map(*[F.lit(x) for kv in ITEM_TITLES.items() for x in kv])
    out = cut.unionByName(whole).join(docs.select("doc_id", "text"), "doc_id")
    out = out.select("doc_id", "item", F.coalesce(F.try_element_at(titles, F.col("item")), F.lit("")).alias("title"), F.expr("trim(substring(text, start + 1, end - start))").alias("text"), "strategy").where(content)
    return out.where((F.col("item") != "15") | F.lower("text").contains("consolidated balance sheets"))


def pack_paragraphs(text: str | None, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to `size` signs; a chunk starts with the last `overlap` signs of the one before; longer paragraphs are cut at a stride of size - overlap."""
    out, held = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n|\n", text or "")):
        if not p:
            continue
        if len(p) > size:
            if held:
                out.append(held)
                held = ""
            cuts = [p[i : i + size] for i in range(0, len(p), size - overlap)]
            out += [c for c in cuts if len(c) > 100]
            continue
        if held and len(held) + 1 + len(p) > size:
            out.append(held)
            held = held[-overlap:] if overlap else ""
        held = f"{held}\n{p}".strip()
    return [*out, held] if held else out


def pack_sentences(text: str | None, size: int = 320, overlap: int = 64, tail: int = 80) -> list[str]:
    """Sentences packed to about `size` signs, with an overlap that starts at a word; a last piece under `tail` is dropped unless alone."""
    out, held = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text or "")):
        if not s:
            continue
        if held and len(held) + 1 + len(s) > size:
            out.append(held)
            held = held[-overlap:].partition(" ")[2] if overlap else ""
        held = f"{held} {s}".strip()
    return [*out, held] if held and (len(held) >= tail or not out) else out


def chunks(parts: DataFrame, size: int, overlap: int, least: int = 150, items: tuple[str, ...] | None = None) -> DataFrame:
    """chunk_id, doc_id, item, seq, text from (doc_id, item, text): numbered before the short ones go."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):  # the chunks of few texts at once, however many a batch has
                b = batch.slice(at, FEW)
                found = [pack_paragraphs(t.as_py(), size, overlap) for t in b.column("text")]
                of = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
                seq, text = pa.array([k for c in found for k in range(len(c))], pa.int32()), pa.array([t for c in found for t in c], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("item").take(of), seq, text], ["doc_id", "item", "seq", "text"])

    rows = (parts if items is None else parts.where(F.col("item").isin(*items))).select("doc_id", "item", "text")
    schema = StructType([rows.schema["doc_id"], rows.schema["item"]]).add("seq", "integer").add("text", "string")
    each = rows.mapInArrow(pack, schema).where(F.length("text") >= least)
    return each.select(F.concat_ws("_", "doc_id", "item", "seq").alias("chunk_id"), "doc_id", "item", "seq", "text")


def report_chunks(pages: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """Chunks of report pages (doc_id, page, text) by sentence."""

    @pandas_udf(ArrayType(StringType()))
    def pack(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pack_sentences(t, size, overlap))

    each = pages.select("doc_id", "page", F.posexplode(pack("text")).alias("seq", "text"))
    return each.select(F.concat_ws("_", "doc_id", "page", "seq").alias("chunk_id"), "doc_id", "page", "seq", "text")


def prose_pages(pages: DataFrame, least: int = 200, digits: float = 0.15) -> DataFrame:
    """Pages with text enough that is not a table of numbers."""
    return pages.where((F.length(F.trim("text")) >= least) & (digit_ratio(F.col("text")) < digits))


def is_report(pages: DataFrame, least_pages: int = 15, least_prose: int = 5) -> DataFrame:
    """doc_id, reason over pages (doc_id, page, text): the first that applies of no_text, too_few_pages, garbled, too_little_prose, else ok."""
    prose = (F.length(F.trim("text")) >= 200) & (digit_ratio(F.col("text")) < 0.15)
    legacy = F.length(F.regexp_replace("text", "[^¡-¿×÷�]", ""))
    d = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(prose).alias("prose"), F.sum(F.length(F.trim("text"))).alias("n"), F.sum(legacy).alias("odd"))
    reason = F.when(F.col("n") == 0, "no_text").when(F.col("pages") < least_pages, "too_few_pages").when(F.try_divide(F.col("odd"), F.col("n")) > 0.05, "garbled").when(F.col("prose") < least_prose, "too_little_prose").otherwise("ok")
    return d.select("doc_id", "pages", "prose", reason.alias("reason"))


def printed_year(texts: DataFrame) -> DataFrame:
    """doc_id, year: the year that a text names at least twice as often as any other; NULL otherwise."""
    years = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))).alias("y"))
    n = years.groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "y")
    top = n.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("doc_id").agg(F.max(F.when(F.col("r") == 1, F.struct("y", "n"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("b"))
    year = F.when(F.col("a.n") >= 2 * F.coalesce("b", F.lit(0)), F.col("a.y").cast("int"))
    return texts.select("doc_id").distinct().join(top.select("doc_id", year.alias("year")), "doc_id", "left")


def scored(parts: DataFrame, orgs: DataFrame, own: DataFrame) -> DataFrame:
    """chunk_id, external, cues, structure, score over chunks (chunk_id, doc_id, item, text); orgs (org) of one lower-case word, own (doc_id, org) are the filer's names.

    Words meet organisations by an equi join; a text's distinct words are few next to its length.
    """
    words = parts.select("chunk_id", "doc_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}0-9]+", " "), " "))).alias("org"))
    named = words.join(orgs.distinct(), "org").join(own.distinct(), ["doc_id", "org"], "left_anti").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("external"))
    j = parts.join(named, "chunk_id", "left").withColumn("external", F.coalesce("external", F.lit(0)))
    j = j.withColumn("cues", F.regexp_count("text", F.lit(RELATION_CUES))).withColumn("structure", F.regexp_count("text", F.lit(STRUCTURE_CUES)))
    bonus = F.when(F.col("item").isin("1A", "7"), 2).otherwise(0)
    score = 5 * F.col("external") + 2 * F.least("cues", F.lit(6)) + 2 * F.least("structure", F.lit(3)) + bonus
    return j.select("chunk_id", "doc_id", "item", "external", "cues", "structure", score.cast("long").alias("score"))


def selected(rows: DataFrame, least: int = 7, budget: int = 300) -> DataFrame:
    """chunk_id, kind, place: chunks of score `least` or more that name another organisation, then at most `budget` that only tell structure (a top-k)."""
    ok = rows.where(F.col("score") >= least)
    named = ok.where("external > 0").select("chunk_id", F.lit("relation").alias("kind"), "score")
    rest = ok.where("external = 0 and structure > 0").orderBy(F.desc("score"), "chunk_id").limit(budget).select("chunk_id", F.lit("structure").alias("kind"), "score")
    return named.unionByName(rest)


def ocr_quality(pages: DataFrame, letters: str, least: float = 0.15, least_signs: int = 200) -> DataFrame:
    """doc_id, ratio, reason (empty, too_few_marked_letters, ok): whether pages read by OCR have the language's marked letters as often as they should."""
    low = F.lower("text")
    marked, all_letters = F.length(F.regexp_replace(low, f"[^{letters}]", "")), F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    d = pages.groupBy("doc_id").agg(F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("n"), F.try_divide(F.sum(marked).cast("double"), F.sum(all_letters).cast("double")).alias("ratio"))
    reason = F.when(F.col("n") < least_signs, "empty").when(F.coalesce("ratio", F.lit(0.0)) < least, "too_few_marked_letters").otherwise("ok")
    return d.select("doc_id", "ratio", reason.alias("reason"))
