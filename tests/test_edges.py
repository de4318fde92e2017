"""Queries over empty tables, and over nulls, repeated rows and clashing columns, equal their SQL twins there too."""

from __future__ import annotations

import pytest

from tests import edges
from tests.oracle import compare
from tidemill.plans.catalogue import REGISTRIES

QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}
DEALT = [n for n in QUERIES if n[0] == "p" and n[1].isdigit()]
OTHERS = ["dedup_latest", "stg_delivery_events", "category_revenue_broadcast", "fact_orders", "window_speed", "late_dropped_windows", "ordering_report", "dim_customer_merge", "primary_key_violations"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {"empty": edges.empty(tmp_path_factory.mktemp("empty")), "awkward": edges.awkward(tmp_path_factory.mktemp("awkward"))}


@pytest.mark.parametrize("name", [*DEALT, *OTHERS])
@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_edge_tables(spark, folders, kind, name):
    ok, said = compare(spark, folders[kind], name, QUERIES[name], SQL.get(name))
    assert ok, said
