from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, key string, fp string, digest string, component_id long, score double"


def prose(rng: random.Random, syllables: str, words: int) -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


SYLLABLES = {"aa": "the an er ing of to re", "bb": "zu ver keit ein lich pf", "cc": "eau ou le que re é"}


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    """Rows of documents with nulls, empty and long texts, exact and near copies, repeated rows, and columns named like an operator's own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, prose(rng, SYLLABLES[lang], rng.randint(3, 80)), lang, f"s{min(i % 7, 3)}"))
    base = rows[0][1]
    rows += [(n, base, "aa", "s0"), (n + 1, base, "aa", "s9"), (n + 2, base + " x", "aa", "s0"), (n + 2, base + " x", "aa", "s0")]
    rows += [(n + 3, None, None, None), (n + 4, "", "aa", None), (n + 5, " \t\n", None, "s1"), (None, "no number here at all", "aa", "s1"), (n + 6, "12 34 !!", "aa", "s2"), (n + 7, "é" * 7, None, "s2")]
    rows.append((n + 8, prose(rng, SYLLABLES["bb"], 9000), "bb", "s0"))
    return [(d, t, g, s, len(t or ""), 5, 6, "k", "f", "d", 7, 0.5) for d, t, g, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
