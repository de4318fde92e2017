from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm.bitmaps import bitmaps, bits_for, estimates, fold, merge, standard_error


def test_sizes_keep_the_error_and_leave_bits_empty():
    for n in (1, 10, 1000, 100_000, 10_000_000):
        for error in (0.05, 0.01, 0.002):
            bits = bits_for(n, error)
            assert bits & (bits - 1) == 0
            assert standard_error(bits, n) <= error
            assert bits == 1024 or standard_error(bits / 2, n) > error or (bits / 2) * 2.718281828 ** (-2 * n / bits) < 25 or 1 / (bits) ** 0.5 > error


def test_partials_merge_over_days_and_fold_to_smaller_sizes(spark):
    rows = [(d, f"id{(i * 31 + d * 17) % 700}") for d in range(3) for i in range(600)] + [(0, None), (None, "id5"), (1, ""), (1, "x" * 100_000)]
    df = spark.createDataFrame(rows, "day int, id string")
    parts = bitmaps(df, ["day"], {"id": 4096})
    again = merge(bitmaps(df.where("day = 0"), ["day"], {"id": 4096}).unionByName(bitmaps(df.where("day <> 0"), ["day"], {"id": 4096})), [])
    whole = {r["word"]: r["mask"] for r in merge(parts.where("day is not null"), []).collect()}
    assert {r["word"]: r["mask"] for r in again.collect()} == whole
    small = {r["word"]: r["mask"] for r in fold(parts, ["day"], 1024).where("day = 0").collect()}
    assert small == {r["word"]: r["mask"] for r in bitmaps(df, ["day"], {"id": 1024}).where("day = 0").collect()}
    want = {int(hashlib.md5(i.encode()).hexdigest()[:12], 16) % 4096 for d, i in rows if d == 2}
    got = {w["word"] * 64 + k for w in parts.where("day = 2").collect() for k in range(64) if w["mask"] >> k & 1}
    assert got == want


def test_estimates_lie_within_the_stated_error(spark):
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.col("id") % 40_000).cast("string").alias("id"))
    bits = bits_for(50_000, 0.01)
    row = estimates(bitmaps(df, ["g"], {"id": bits}), ["g"]).first()
    assert abs(row["estimate"] - 40_000) <= 4 * row["relative_error"] * 40_000
    assert row["relative_error"] <= 0.01


def test_full_bitmaps_null_groups_cubes_and_empty_input(spark):
    df = spark.range(5000).select(F.lit(None).cast("string").alias("g"), F.lit(1).alias("h"), F.col("id").cast("string").alias("id"))
    row = estimates(bitmaps(df, ["g"], {"id": 64}), ["g"]).first()
    assert row["estimate"] is None and row["relative_error"] is None and row["g"] is None
    few = df.limit(10)
    cube = {(r["g"], r["h"], r["combination"]): r["estimate"] for r in estimates(bitmaps(few, ["g", "h"], {"id": 1024}), [], ["g", "h"]).collect()}
    assert cube == {(None, 1, 0): 10, (None, None, 1): 10, (None, 1, 2): 10, (None, None, 3): 10}
    assert estimates(bitmaps(df.limit(0), ["g"], {"id": 1024}), ["g"]).collect() == []
    with pytest.raises(ValueError):
        bitmaps(df, ["g"], {"id": 1000})
