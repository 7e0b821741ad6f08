"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point. A letter n-gram is bound
from its letters: the vector of the letter at place i is permuted i times (rotated) and the results are multiplied.
A document is the bundle (sum) of its n-grams, a language the bundle of its documents, and a document is
given the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasslark.llm.common import held_out

DIM = 1024
GRAM = 3
SEED = 5
#: Letters, and n-grams, whose vectors a task keeps at once.
KEPT = 8192
#: Documents are scaled to this length before they are summed as integers, so that sums do not depend on their order.
UNIT = 1 << 20
UNDETERMINED = "und"


class Binder:
    """Vectors of n-grams, kept while there is room."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.table = np.empty((KEPT, dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= KEPT:
                self.letters.clear()
            self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dim, np.int8) * 2 - 1
        return self.letters[code]

    def bind(self, key: int) -> np.ndarray:
        """The n-gram packed in key, 21 bits a letter."""
        out = np.ones(self.dim, np.int8)
        for place in range(self.gram):
            out = out * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return out

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it occurs."""
        out = np.zeros(self.dim, np.float32)
        for at in range(0, len(keys), KEPT // 2):
            part = keys[at : at + KEPT // 2].tolist()
            if len(self.grams) + len(part) > KEPT:
                self.grams.clear()
            rows = []
            for k in part:
                row = self.grams.get(k)
                if row is None:
                    row = self.grams[k] = len(self.grams)
                    self.table[row] = self.bind(k)
                rows.append(row)
            out += counts[at : at + KEPT // 2].astype(np.float32) @ self.table[rows]
        return out


@cache
def alphabetic() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space, a space at each end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[~alphabetic()[codes]] = 32
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def grams(text: str, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter n-grams of a text, packed 21 bits a letter, and their counts; none if it has no letter."""
    codes = letters(text)
    if len(codes) < max(3, gram):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(codes) - gram + 1
    keys = sum(codes[i : i + n] << 21 * i for i in range(gram))
    return np.unique(keys, return_counts=True)


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray  # unit length, one row a language
    dim: int = DIM
    gram: int = GRAM


def train(docs: DataFrame, dim: int = DIM, gram: int = GRAM) -> Profiles:
    """Prototypes from all rows of docs (text, lang) with a language and a letter.

    Each document is scaled to one length first, so long ones don't outweigh the rest. A task gives one
    vector a language, and Spark adds them up place by place. The model is as large as the set of languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, sums = Binder(dim, gram), {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                keys, counts = grams(text, gram)
                if len(keys):
                    v = binder.bundle(keys, counts)
                    sums.setdefault(lang, np.zeros(dim, np.int64))
                    sums[lang] += np.rint(v * (UNIT / max(1e-9, float(np.linalg.norm(v))))).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim)), pa.array(v)], ["lang", "place", "v"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(run, "lang string, place long, v long").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("v")).orderBy("lang").collect()
    vectors = np.array([r["v"] for r in found], np.float64).reshape(-1, dim)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    return Profiles([r["lang"] for r in found], vectors.astype(np.float32), dim, gram)


def predict(docs: DataFrame, model: Profiles, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score (or other names), the cosine with the best prototype (0 if negative).

    A null text or one without a letter is `und` with score 0, as is everything if no language was learned.
    Equal cosines give the first language in code point order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.prototypes))
    dim, gram = model.dim, model.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        binder = Binder(dim, gram)
        for b in batches:
            found, scores = [], []
            for text in b.column("text").to_pylist():
                keys, counts = grams(text or "", gram)
                if len(keys) and langs:
                    v = binder.bundle(keys, counts)
                    cosines = prototypes @ v / max(1e-9, float(np.linalg.norm(v)))
                    best = int(np.argmax(cosines))
                    found.append(langs[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
                else:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    kinds = dict(docs.dtypes)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string", f"`{names[1]}` double"]))


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs, learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), parts, part)
    return predict(docs, train(docs.where(~out)), "doc_id").withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
