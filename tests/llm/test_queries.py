from __future__ import annotations

import pytest

from tests.oracle import compare
from tidemill.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", REGISTRY.queries)
def test_query_equals_sql(spark, name):
    ok, said = compare(spark, FOLDER, name, REGISTRY.queries[name], REGISTRY.sql.get(name))
    assert ok, said
