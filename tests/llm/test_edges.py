from __future__ import annotations

import pytest

from tests import edges
from tests.oracle import compare
from tidemill.llm.queries import REGISTRY


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {"empty": edges.empty(tmp_path_factory.mktemp("empty")), "awkward": edges.awkward(tmp_path_factory.mktemp("awkward"))}


@pytest.mark.parametrize("name", REGISTRY.queries)
@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_edge_tables(spark, folders, kind, name):
    ok, said = compare(spark, folders[kind], name, REGISTRY.queries[name], REGISTRY.sql.get(name))
    assert ok, said
