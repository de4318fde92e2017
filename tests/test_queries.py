"""Every core query with a SQL twin equals it; the others run."""

from __future__ import annotations

import importlib

import pytest

from tests.oracle import compare
from tidemill.plans.catalogue import REGISTRIES

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    ok, said = compare(spark, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, said


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
