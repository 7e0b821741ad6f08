"""Toxicity: a counterfactually regularised classifier of whole texts.

A logistic regression on the presence of words and of word beginnings (hashed to 2**WIDTH buckets), so a score
does not fade with the length of a text. Sentences of the labelled texts that name a group are written again with other groups in its place, and
the training loss adds the squared change of the score between the two. Groups are listed names and, since those bear on
few languages, terms mined from the labelled texts: words that toxic texts have more often than chance gives any of the words
tested, though most texts that have them are neutral, and that stand between the same words. A group's name alone therefore can't
raise a score, which keeps neutral mentions from being flagged. An L1 pass chooses the words that matter, a second pass fits
their weights. Where texts have neither, there is nothing to rewrite and the model is a plain logistic regression (`Model.pairs` is 0).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import held_out, labelled_sample, saved

WIDTH = 22
#: Letters of a word's beginnings that are features beside the word, for languages that build on stems.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled documents to fit on, and different pairs of rewritten sentences for each of them, about.
SAMPLE, PAIRS_EACH = 20_000, 2.5
#: Terms put in the place of the one named, in turn.
SWAPS = 3
#: Labelled documents that a mined term needs, the chance that any word at all is taken though labels don't depend on words,
#: the largest share of label 1 (most texts that have a term are neutral), the neighbours that two terms need in common to stand
#: for each other, and terms of a group.
TERM_ROWS, TERM_CHANCE, TERM_SHARE, TERM_SLOTS, TERM_GROUP = 20, 0.05, 0.5, 2, 6
#: Weight of the L1 norm in the first pass, of the L2 norm in the second, and of squared score changes in both.
L1, L2, COUNTERFACTUAL = 0.004, 1e-4, 4.0

#: Names of groups that can stand for each other in a sentence.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "arab", "hispanic", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "trans"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "migrant", "citizen"),
    ("disabled", "blind", "deaf", "elderly", "young", "autistic"),
    ("americans", "mexicans", "chinese", "germans", "french", "russians", "indians", "turks"),
    ("american", "mexican", "german", "russian", "indian", "turkish", "polish", "japanese"),
    ("frauen", "männer", "mädchen", "jungen", "kinder"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"), ("schwule", "lesben", "homosexuelle", "heterosexuelle", "transsexuelle"),
    ("ausländer", "flüchtlinge", "einheimische", "migranten", "einwanderer"), ("deutsche", "türken", "polen", "russen", "franzosen", "amerikaner"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"), ("homosexuels", "lesbiennes", "hétérosexuels", "transgenres"),
    ("étrangers", "réfugiés", "migrants", "immigrés", "citoyens"), ("français", "allemands", "russes", "américains", "turcs", "polonais"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"), ("homosexuales", "lesbianas", "heterosexuales", "transexuales"),
    ("extranjeros", "refugiados", "inmigrantes", "migrantes", "ciudadanos"), ("españoles", "alemanes", "rusos", "mexicanos", "americanos", "turcos"),
)
GROUP_OF = {term: group for group in reversed(IDENTITY) for term in group}

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's words, of the beginnings of longer words, and of those that several words share, ascending."""
    h, mask = xxhash.xxh32_intdigest, (1 << WIDTH) - 1
    words = set(_WORD.findall(text.lower()))
    found = [f"{w}$" for w in words]
    for n in BEGINNINGS:
        shared = Counter([w[:n] for w in words if len(w) > n])
        found += shared
        found += [f"{w}+" for w, k in shared.items() if k > 1]
    return np.array(sorted({h(w) & mask for w in found}), np.int32)


def rewritten(text: str, groups: dict[str, tuple[str, ...]] = GROUP_OF) -> list[tuple[str, str]]:
    """(sentence, the sentence with other terms) for every sentence that has a term of a group."""
    out = []
    for m in _SENTENCE.finditer(text.lower()):
        named = any(w in groups for w in _WORD.findall(m[0]))
        for turn in range(1, SWAPS + 1 if named else 1):
            def other(w: re.Match, turn: int = turn) -> str:
                group = groups.get(w[0])
                return group[(group.index(w[0]) + turn) % len(group)] if group else w[0]

            out.append((m[0], _WORD.sub(other, m[0])))
    return out


def slots(text: str, terms: frozenset[str]) -> list[tuple[str, str]]:
    """(term, its neighbours) for each place of a term in a sentence; the ends of a sentence are neighbours too."""
    out = []
    for m in _SENTENCE.finditer(text.lower()):
        words = ["", *_WORD.findall(m[0]), ""]
        out += [(w, f"{words[i]} _ {words[i + 2]}") for i, w in enumerate(words[1:-1]) if w in terms]
    return out


def mined_groups(rows: DataFrame, n: int, positive: int) -> dict[str, tuple[str, ...]]:
    """Terms of the labelled texts (text, label) whose share of label 1 is uneven though most texts that have them are neutral, by group.

    Such words go with toxic texts without making a text toxic, as names of groups do, in whatever language the corpus has. A
    word's excess must be beyond what TERM_CHANCE gives over all words tested, by Chernoff's bound on the binomial tail. Terms
    that stand between the same two words in TERM_SLOTS ways stand for each other. They are as few as the words of the sample
    that pass the tests.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                own = sorted(set(_WORD.findall(text.lower())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([int(label > 0)] * len(own), pa.int64())], ["word", "y"])

    p = positive / n
    counts = rows.select("text", "label").mapInArrow(words, "word string, y long").groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("y").alias("bad"))
    counts = saved(counts.where(F.col("seen") >= TERM_ROWS), "words")
    tested, share = counts.count(), F.col("bad") / F.col("seen")
    if not tested:
        return {}
    nats = share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p))  # of the word's texts, off the whole's
    found = counts.where((share > p) & (share <= TERM_SHARE) & (F.col("seen") * nats >= math.log(tested / TERM_CHANCE))).select("word", share.alias("share")).collect()
    shares = {r["word"]: r["share"] for r in found if r["word"] not in GROUP_OF}
    if len(shares) < 2:
        return {}
    terms = frozenset(shares)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = sorted({s for text in b.column("text").to_pylist() for s in slots(text, terms)})
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*own, strict=True) if own else ([], []))], ["term", "slot"])

    each = saved(rows.select("text").mapInArrow(places, "term string, slot string").distinct(), "slots")
    pairs = each.join(each.select(F.col("term").alias("other"), "slot"), "slot").where("term < other")  # of the few terms found
    alike = {(r["term"], r["other"]) for r in pairs.groupBy("term", "other").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= TERM_SLOTS).collect()}
    groups: list[list[str]] = []
    for t in sorted(shares, key=lambda w: (shares[w], w)):
        fit = next((g for g in groups if len(g) < TERM_GROUP and all((min(t, u), max(t, u)) in alike for u in g)), None)
        if fit:
            fit.append(t)
        else:
            groups.append([t])
    return {t: tuple(g) for g in groups if len(g) > 1 for t in g}


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        labels = [int(y > 0) for y in b.column("label").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([buckets(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["y", "x"])


class Telling(dict):
    """The telling buckets of texts. What a word adds is kept while there is room, so many short texts cost little."""

    def __init__(self, columns: np.ndarray):
        super().__init__()
        self.columns = frozenset(columns.tolist())

    def __missing__(self, word: str) -> tuple[frozenset[int], list[tuple[str, int]]]:
        """The word's own telling buckets, and its beginnings whose bucket tells if another word has them too."""
        if len(self) > 1 << 18:
            self.clear()
        h, mask = xxhash.xxh32_intdigest, (1 << WIDTH) - 1
        starts = [word[:n] for n in BEGINNINGS if len(word) > n]
        own = frozenset(h(f) & mask for f in (f"{word}$", *starts)) & self.columns
        shared = [(w, h(f"{w}+") & mask) for w in starts]
        self[word] = out = (own, [(w, b) for w, b in shared if b in self.columns])
        return out

    def of(self, text: str) -> bytes:
        """Those of buckets(text) that tell, as bytes."""
        found: set[int] = set()
        met: set[str] = set()
        for word in set(_WORD.findall(text.lower())):
            own, shared = self[word]
            found |= own
            for w, b in shared:
                if w in met:
                    found.add(b)
                met.add(w)
        return np.array(sorted(found), np.int32).tobytes()


class Rows:
    """Sparse rows of ones over the columns kept."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        self.n, self.width = len(rows), len(columns)
        flat = np.concatenate([*rows, np.empty(0, np.int32)])
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(columns, flat)
        hit = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == flat) if len(columns) else np.zeros(len(flat), bool)
        self.own, self.at = own[hit], at[hit]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.own], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(x: Rows, y: np.ndarray, before: Rows, after: Rows, l1: float, l2: float, weight: float, steps: int, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the logistic loss, the penalty on score changes, and the norms. times: how often each pair occurs."""
    times = np.ones(before.n) if times is None else times
    w, n, m = np.zeros(x.width), max(1, x.n), max(1.0, float(times.sum()))
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    ahead, ahead_bias, t, rate = w, bias, 1.0, 1.0

    def loss(w: np.ndarray, b: float) -> float:
        z = x.times(w) + b
        change = sigmoid(before.times(w) + b) - sigmoid(after.times(w) + b)
        return float((np.logaddexp(0, z) - y * z).sum() / n + weight * (times @ change**2) / m + l2 / 2 * (w @ w))

    for _ in range(steps):
        r = (sigmoid(x.times(ahead) + ahead_bias) - y) / n
        s0, s1 = sigmoid(before.times(ahead) + ahead_bias), sigmoid(after.times(ahead) + ahead_bias)
        c = 2 * weight / m * times * (s0 - s1)
        g = x.back(r) + before.back(c * s0 * (1 - s0)) - after.back(c * s1 * (1 - s1)) + l2 * ahead
        gb = float(r.sum() + (c * (s0 * (1 - s0) - s1 * (1 - s1))).sum())
        here = loss(ahead, ahead_bias)
        while True:
            new = ahead - rate * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            new_bias = ahead_bias - rate * gb
            d, db = new - ahead, new_bias - ahead_bias
            if loss(new, new_bias) <= here + g @ d + gb * db + (d @ d + db * db) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, ahead_bias = new + (old - 1) / t * (new - w), new_bias + (old - 1) / t * (new_bias - bias)
        w, bias, rate = new, new_bias, rate * 1.3
    return w, bias


@dataclass
class Model:
    """pairs: the rewritten sentences that bear on the penalty, those whose telling words differ from the sentence's."""

    bias: float
    columns: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    pairs: int = 0

    def score(self, text: str) -> float:
        x = buckets(text)
        z = self.bias + float(self.weights[np.isin(self.columns, x, assume_unique=True)].sum()) if len(self.columns) else self.bias
        return float(sigmoid(np.array(z)))


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, seen, bad): the task's documents with each bucket, and those of them with label 1."""
    seen, bad = (np.zeros(1 << WIDTH, np.int32) for _ in range(2))
    for b in batches:
        for y, x in zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True):
            at = np.frombuffer(x, np.int32)
            seen[at] += 1
            bad[at] += y
    met = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[met].astype(np.int64)), pa.array(bad[met].astype(np.int64))], ["bucket", "seen", "bad"])


def telling(features: DataFrame, n: int, positive: int) -> np.ndarray:
    """The buckets seen in 3 documents or more whose share of label 1 is 3 standard errors or more off the whole's."""
    p = positive / n
    counts = features.select("y", "x").mapInArrow(bucket_counts, "bucket int, seen long, bad long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    off = F.abs(F.col("bad") - p * F.col("seen")) >= 3 * F.sqrt(F.col("seen") * p * (1 - p))
    found = counts.where((F.col("seen") >= 3) & off).select("bucket").toArrow()
    return np.sort(found.column("bucket").to_numpy().astype(np.int32))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL, pairs_each: float = PAIRS_EACH) -> Model:
    """The model from about `sample` labelled documents outside the held-out part, and their rewritten sentences.

    Of different pairs of sentences about pairs_each * sample are fitted on (all if there are fewer): a pair is drawn with a chance
    in proportion to how often it occurs and weighs its count over that chance, so the penalty has the same mean as with all.

    Buckets are counted by Spark; the driver sees only those that tell the labels apart, of the sample's documents.
    """
    chosen = saved(labelled_sample(docs, labels, "toxic", parts, part, sample), "chosen")
    n, positive = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not n or positive in (0, n):
        return Model(bias=10.0 if n and positive else -10.0)
    features = saved(chosen.mapInArrow(sample_features, "y int, x binary"), "features")
    columns = telling(features, n, positive)
    groups = mined_groups(chosen, n, positive) | GROUP_OF
    shared = docs.sparkSession.sparkContext.broadcast((columns, groups))

    def cut(x: np.ndarray) -> bytes:
        return np.intersect1d(x, shared.value[0], assume_unique=True).tobytes()

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([cut(np.frombuffer(x, np.int32)) for x in b.column("x").to_pylist()], pa.binary())], ["y", "x"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling_of = Telling(shared.value[0])
        for b in batches:
            for text in b.column("text").to_pylist():
                pairs = Counter((telling_of.of(u), telling_of.of(v)) for u, v in rewritten(text, shared.value[1]))
                pairs = [(u, v, k) for (u, v), k in pairs.items() if u != v]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["before", "after", "k"])

    rows = features.mapInArrow(narrowed, "y int, x binary").toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    # Sentences alike in their telling words are one pair with a count, so few pairs reach the driver.
    found = saved(chosen.select("text").mapInArrow(swapped, "before binary, after binary, k long").groupBy("before", "after").agg(F.sum("k").alias("k")), "pairs")
    total = found.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    chance = F.least(F.lit(1.0), F.col("k") * (pairs_each * sample / max(total, 1)))
    drawn = found.withColumn("chance", chance).where(F.pmod(F.xxhash64("before", "after"), F.lit(1 << 40)) < F.col("chance") * (1 << 40))
    pairs = drawn.select("before", "after", (F.col("k") / F.col("chance")).alias("k")).toArrow().sort_by([("before", "ascending"), ("after", "ascending")])
    ids = lambda table, c: [np.frombuffer(b.as_py(), np.int32) for b in table.column(c)]
    y, times = rows.column("y").to_numpy().astype(float), pairs.column("k").to_numpy().astype(float)
    x, before, after = ids(rows, "x"), ids(pairs, "before"), ids(pairs, "after")
    for l1, l2, steps in ((L1, 0.0, 150), (0.0, L2, 200)):
        w, bias = descend(Rows(x, columns), y, Rows(before, columns), Rows(after, columns), l1, l2, counterfactual, steps, times)
        if l1:
            columns = columns[np.abs(w) > 1e-6]
    return Model(bias, columns, w, int(total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of docs; null and empty texts have the score of a text without telling words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def judge(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    scored = score(docs, fit(docs, labels, parts, part, **options))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
