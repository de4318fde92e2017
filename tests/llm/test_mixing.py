from __future__ import annotations

import random

from tidemill.llm.mixing import mix, rates, reached

TARGETS = "source string, target_share double, max_repeats int"


def test_shares_caps_and_proportions(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else "mid", rng.randint(1, 400)) for i in range(6000)] + [(10_000 + i, "small", rng.randint(1, 400)) for i in range(150)]
    rows += [(None, "big", 5), (20_000, None, 5), (20_001, "big", None), (20_002, "other", 7), (20_003, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 3), (None, 0.5, 1), ("other", None, 2)], TARGETS)
    got = mix(docs, targets)
    rate = {r["source"]: r for r in rates(docs.where("doc_id is not null and source is not null and tokens > 0"), targets).collect()}
    assert set(rate) == {"big", "mid", "small"}
    shares = {r["source"]: r for r in reached(got, targets).collect()}
    for s, want in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(shares[s]["reached_share"] - want) < 0.01, s
    assert shares["gone"]["copies"] == 0
    for r in got.collect():
        low = int(rate[r["source"]]["rate"])
        assert r["copies"] in (low, low + 1) and 1 <= r["copies"] <= rate[r["source"]]["max_repeats"]
    assert max(rate[s]["rate"] / rate[s]["max_repeats"] for s in rate) > 1 - 1e-9
    less = {r["source"]: r["tokens"] for r in reached(mix(docs, targets, 50_000), targets).collect()}
    assert abs(sum(less.values()) - 50_000) < 2_000


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, "a", 3), (1, "a", 3)], "doc_id long, source string, tokens long")
    none = spark.createDataFrame([], TARGETS)
    assert mix(docs, none).collect() == []
    one = spark.createDataFrame([("a", 1.0, 2), ("a", 0.5, 9)], TARGETS)
    assert mix(docs.limit(0), one).collect() == []
    assert sorted(tuple(r) for r in mix(docs, one).collect()) == [(1, "a", 3, 2), (1, "a", 3, 2)]
