from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tidemill.operators import sized
from tidemill.operators.selection import dominant, order_statistics, quantiles


def brute(values, share):
    values = sorted(values)
    return values[max(1, math.ceil(share * len(values))) - 1]


def test_quantiles_equal_sorting_for_hot_keys_ties_and_few_bins(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([0.0, -1.5, 1e300, -1e300, 5e-324, rng.gauss(0, 1)])) for _ in range(4000)]
    rows += [(f"k{i % 7}", rng.uniform(-5, 5)) for i in range(500)] + [("one", 3.0), (None, 1.0), ("hot", None), ("hot", float("nan")), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", [0.01, 0.5, 0.99, 1.0], bins=8).collect()}
    want = {}
    for k, v in rows:
        if k is not None and v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        assert got[k]["n"] == len(vs)
        assert [got[k][c] for c in ("q1", "q50", "q99", "q100")] == [brute(vs, s) for s in (0.01, 0.5, 0.99, 1.0)], k


def test_whole_numbers_far_apart_and_close_together(spark):
    values = [-(2**63), 2**63 - 1, 2**62, 2**62 + 1, 2**62 + 2, 0, 0, 1]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v long")
    out = order_statistics(df, ["k"], "v", F.sequence(F.lit(1).cast("bigint"), F.col("n")), bins=4).orderBy("rank").collect()
    assert [r["value"] for r in out] == sorted(values)
    assert [r["at_value"] for r in out] == [sorted(values).count(v) for v in sorted(values)]


def test_empty_and_ranks_out_of_range(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert quantiles(empty, ["k"], "v", [0.5]).collect() == []
    one = spark.createDataFrame([("a", 5)], "k string, v long")
    assert [tuple(r) for r in order_statistics(one, ["k"], "v", F.array(F.lit(0), F.lit(1), F.lit(9)).cast("array<bigint>")).collect()] == [("a", 1, 1, 5, 1)]


def test_dominant_keys_and_salted_path(spark, monkeypatch):
    rows = [("g", "a")] * 50 + [("g", "b")] * 20 + [("g", f"c{i}") for i in range(30)] + [("h", None)] * 9 + [("h", "z"), ("h", "y")]
    df = spark.createDataFrame(rows, "grp string, k string").withColumn("extra", F.lit(1))
    least = F.expr("(n + 4) div 5")
    want = {("g", "a", 100, 50), ("g", "b", 100, 20), ("h", "z", 2, 1), ("h", "y", 2, 1)}
    assert {tuple(r) for r in dominant(df, ["grp"], "k", least).collect()} == want
    monkeypatch.setattr(sized, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sized, "fits_broadcast", lambda *a, **k: False)
    assert {tuple(r) for r in dominant(df, ["grp"], "k", least).collect()} == want
