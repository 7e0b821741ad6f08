"""Vector search in cells equals scores of all pairs, and forms no rows of pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from brasslark.operators import vector
from brasslark.plans.queries import QUERIES
from tests.conftest import SMALL


def score(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / length if length else None


@pytest.mark.parametrize("unscored", [False, True])
def test_hits_equal_all_pairs(spark, monkeypatch, unscored):
    monkeypatch.setattr(vector, "VECTORS", 20)
    monkeypatch.setattr(vector, "QUERIES", 3)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], i % 2) for i in range(60)]  # many ties
    rows += [(60, None, 0), (61, [0.0] * 3, 0), (62, [1.0, None, 1.0], 1), (63, [1.0, 2.0], 1), (64, [], 0)]
    asked = [(i, v, o) for i, v, o in rows if i % 5 == 0 or i > 59]
    vectors, query = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark.createDataFrame(asked, "query_id long, query array<float>, odd int")
    for on in ((), ((F.col("label"), F.col("odd")),)):
        got = {(r["query_id"], r["place"]): r["vec_id"] for r in vector.hits(vectors, query, 4, keep=("label",), on=on, unscored=unscored).collect()}
        want = {}
        for i, q, odd in asked:
            each = [(s is None, -(s or 0.0), v) for v, e, o in rows if not on or o == odd for s in [score(e, q)] if unscored or s is not None]
            want |= {(i, k): v for k, (_, _, v) in enumerate(sorted(each)[:4], 1)}
        assert got == want


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_filtered", "stacked_hits", "search_relaxation"])
def test_no_rows_of_pairs(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
