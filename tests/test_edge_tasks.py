"""Tasks of the queries over knowledge edges."""

from __future__ import annotations

from brasslark import catalog
from brasslark.plans.queries import QUERIES
from tests.conftest import SMALL


def test_neighbors_directed_deals_edges_by_line_items(spark, monkeypatch):
    """Tasks have as many line items at any size; those that adaptive execution makes by compressed bytes took GB of memory."""
    monkeypatch.setattr(catalog, "LINES", 300)
    tasks = catalog.edge_tasks(spark, SMALL)
    assert tasks == -(-catalog.table(spark, SMALL, "lineitem").count() // 300) > 8
    assert QUERIES["neighbors_directed"](spark, SMALL).rdd.getNumPartitions() == tasks


def test_entity_merge_deals_edges_by_line_items(spark, monkeypatch):
    """Tasks have as many line items at any size; those that adaptive execution makes by compressed bytes took GB of memory."""
    monkeypatch.setattr(catalog, "LINES", 300)
    tasks = catalog.edge_tasks(spark, SMALL)
    assert tasks == -(-catalog.table(spark, SMALL, "lineitem").count() // 300) > 8
    assert QUERIES["entity_merge"](spark, SMALL).rdd.getNumPartitions() == tasks


def test_upsert_edges_deals_edges_by_line_items(spark, monkeypatch):
    """Tasks have as many line items at any size; those that adaptive execution makes by compressed bytes took GB of memory."""
    monkeypatch.setattr(catalog, "LINES", 300)
    tasks = catalog.edge_tasks(spark, SMALL)
    assert tasks == -(-catalog.table(spark, SMALL, "lineitem").count() // 300) > 8
    assert QUERIES["upsert_edges"](spark, SMALL).rdd.getNumPartitions() == tasks
