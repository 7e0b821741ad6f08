"""Quality: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

Every word (hashed to one of BUCKETS) has a sparse random index vector. A word's vector is the sum of the
index vectors of the words within WINDOW places of it, over all documents of the corpus. A document is the mean
and the spread of its words' vectors, and the mean product of neighbours' (which tells repetition). A network with one hidden layer turns that into a logit, and a temperature
fitted on labelled rows that the network did not see makes the probability honest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import held_out, labelled_sample

BUCKETS = 1 << 14
DIM = 64
#: Numbers that a document is pooled to.
POOLED = 3 * DIM
#: Places of an index vector that are not zero, and neighbours on each side that count.
NONZERO, WINDOW = 4, 2
SEED = 10
#: Labelled documents to fit on, about; the share of them that sets the temperature.
SAMPLE, CALIBRATION = 20_000, 0.2
HIDDEN = 32
#: Words whose neighbours are added up at once.
CHUNK = 1 << 17

#: Words as they are written, and runs of other signs.
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1


class Hasher(dict):
    """Buckets of words, kept while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word) % BUCKETS
        return h

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter((self[w] for w in _TOKEN.findall(text)), np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM sums over all rows of docs (text); each task gives the buckets it has met, Spark adds them up."""
    columns = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        hasher, sums, met = Hasher(), np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, bool)

        def add(ids: np.ndarray) -> None:
            met[ids[ids >= 0]] = True
            for o in range(1, WINDOW + 1):
                for i in range(0, len(ids) - o, CHUNK):  # a very long text is taken in parts
                    a, b = ids[i : min(i + CHUNK, len(ids) - o)], ids[i + o : i + o + CHUNK]
                    own = (a >= 0) & (b >= 0)
                    for to, of in ((a[own], b[own]), (b[own], a[own])):
                        at = (to[:, None] * DIM + places[of]).ravel()
                        np.add.at(sums, at, signs[of].ravel())

        gap, held, n = np.full(WINDOW, -1), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                ids = hasher.ids(text)
                held += [ids, gap]
                n += len(ids)
                if n >= CHUNK:
                    add(np.concatenate(held))
                    held, n = [], 0
        if held:
            add(np.concatenate(held))
        rows = np.flatnonzero(met)
        table = sums.reshape(BUCKETS, DIM)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(table[:, i]) for i in range(DIM))], ["bucket", *columns])

    rows = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(run, ", ".join(["bucket long", *(f"{c} long" for c in columns)]))
    out = np.zeros((BUCKETS, DIM))
    for r in parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r[1:]
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Word vectors without what they all share, at unit length."""
    length = lambda v: np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    unit = vectors / length(vectors)
    met = np.abs(vectors).sum(1) > 0
    centred = unit - (unit[met].mean(0) if met.any() else 0)
    return np.where(met[:, None], centred / length(centred), 0).astype(np.float32)


def pooled(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's words, and the mean product of neighbours; zeros for a text without words."""
    if not len(ids):
        return np.zeros(POOLED, np.float32)
    met, counts = np.unique(ids, return_counts=True)
    share, rows = (counts / len(ids)).astype(np.float32), table[met]
    mean, near = share @ rows, np.zeros(DIM, np.float32)
    for i in range(0, len(ids) - 1, CHUNK):
        after = table[ids[i + 1 : i + 1 + CHUNK]]
        near += np.einsum("ij,ij->j", table[ids[i : i + len(after)]], after)
    spread = np.sqrt(np.maximum(0, share @ (rows * rows) - mean * mean))
    return np.concatenate((mean, spread, near / max(1, len(ids) - 1)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    """Two layers: tanh(x W + b) V + c over standardised features, divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w + self.b) @ self.v + self.c

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Adam on the logistic loss, then the temperature of least loss on rows kept apart."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    apart, own = np.split(order, [int(CALIBRATION * len(y))])
    net = Network(x[own].mean(0), x[own].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    params = {"w": net.w, "b": net.b, "v": net.v, "c": np.zeros(())}
    first, second = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    z, step = (x - net.shift) / net.scale, 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            i = own[at : at + batch]
            h = np.tanh(z[i] @ params["w"] + params["b"])
            r = (sigmoid(h @ params["v"] + params["c"]) - y[i]) / len(i)
            back = np.outer(r, params["v"]) * (1 - h * h)
            grads = {"w": z[i].T @ back + decay * params["w"], "b": back.sum(0), "v": h.T @ r + decay * params["v"], "c": r.sum()}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w, net.b, net.v, net.c = params["w"], params["b"], params["v"], float(params["c"])
    if len(apart):
        logits = net.logit(x[apart])
        loss = lambda t: float((np.logaddexp(0, logits / t) - y[apart] * logits / t).mean())
        net.temperature = min(np.geomspace(0.25, 8, 101).tolist(), key=lambda t: (loss(t), t))
    return net


@dataclass
class Model:
    table: np.ndarray
    network: Network | None
    constant: float = 0.5

    def scores(self, texts: list[str | None], hasher: Hasher) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.probability(np.array([pooled(hasher.ids(t or ""), self.table) for t in texts]).reshape(-1, POOLED))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, sample: int = SAMPLE) -> Model:
    """Word vectors from all of docs, the network from about `sample` labelled documents outside the held-out part.

    With labels of one kind only, or none, every score is the share of label 1 (0.5 without labels).
    """
    table = scaled(word_vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            x = [pooled(hasher.ids(t), shared.value).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.binary())], ["y", "x"])

    rows = labelled_sample(docs, labels, "quality", parts, part, sample).mapInArrow(run, "y int, x binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))
    y = np.array([r["y"] > 0 for r in rows], float)
    if len(y) < 10 or y.min() == y.max():
        return Model(table, None, float(y.mean()) if len(y) else 0.5)
    return Model(table, train(np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows], float), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of docs; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            out = shared.value.scores(b.column("text").to_pylist(), hasher)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def judge(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs (doc_id, text), learned from labels (doc_id, quality)."""
    scored = score(docs, fit(docs, labels, parts, part, **options))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
