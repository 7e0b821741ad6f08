"""Every query of the catalogue runs, and agrees with its SQL twin where it has one."""

from __future__ import annotations

import pytest

from brasslark.plans.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import connect, plain


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()
