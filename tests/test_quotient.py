from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import quotient
from tidemill.operators.quotient import QuotientTable, quotient_dedup


def brute(rows):
    best = {}
    for k, (i, t, p) in enumerate(rows):
        key = (i or "").strip().lower()
        if key:
            rank = (t if t is not None else 2**70, p)
            if key not in best or rank < best[key][0]:
                best[key] = (rank, k)
    kept = {k for _, k in best.values()}
    return [(rows[k][2], k in kept or not (rows[k][0] or "").strip()) for k in range(len(rows))]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "id string, t long, p long").repartition(3)
    out = quotient_dedup(df, "id", {"t": F.col("t"), "p": F.col("p")}, ["p"], **more)
    return sorted(tuple(r) for r in out.collect())


def test_equals_brute_force_with_nulls_spellings_and_odd_identifiers(spark):
    rng = random.Random(1)
    uuids = ["%08x-%04x-%04x-%04x-%012x" % tuple(rng.getrandbits(b) for b in (32, 16, 16, 16, 48)) for _ in range(300)]
    pool = [*uuids, "plain", "x" * 5000, "ünï", uuids[0].replace("-", ""), "0", None, "", "  "]
    rows = []
    for p in range(3000):
        i = rng.choice(pool)
        i = i and rng.choice([i, i.upper(), f" {i} "])
        rows.append((i, rng.choice([None, 1, 2, 3]), p))
    assert run(spark, rows) == sorted(brute(rows))


def test_one_hot_identifier_in_small_local_tables(spark, monkeypatch):
    monkeypatch.setattr(quotient, "LOCAL_ROWS", 100)
    hot = "00000000-0000-0000-0000-000000000001"
    rows = [(hot if p % 3 else f"k{p}", 5000 - p, p) for p in range(3000)]
    assert run(spark, rows, shard_rows=500) == sorted(brute(rows))


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("a", 1, 1, "x"), ("A", 2, 2, "y")], "id string, t long, p long, _id string").withColumn("_shard", F.lit(3))
    out = quotient_dedup(df, "id", {"t": F.col("t")}, ["p"]).collect()
    assert sorted(tuple(r) for r in out) == [(1, True), (2, False)]
    try:
        quotient_dedup(df, "id", {"t": F.col("t")}, ["p", "_id"])
        raise AssertionError("a clash must raise")
    except ValueError:
        pass


def test_table_never_confuses_identifiers_that_share_a_slot():
    keys = np.array([[7, k % 5, k % 2] for k in range(1000)], np.int64)
    table = QuotientTable()
    entries = table.insert(keys)
    again = table.insert(keys[::-1])
    assert table.size == 10
    assert (again[::-1] == entries).all()
    assert all((table.keys[e] == k).all() for e, k in zip(entries, keys, strict=True))


def test_full_ties_keep_the_same_copy_however_rows_are_spread(spark):
    rows = [("k", 1, p % 50, f"v{p}") for p in range(200)]
    df = spark.createDataFrame([(i, t, 0, v) for i, t, _, v in rows], "id string, t long, p long, v string")
    kept = {tuple(r) for n in (1, 3, 7) for r in quotient_dedup(df.repartition(n), "id", {"t": F.col("t")}, ["v"]).where("is_kept").collect()}
    assert len(kept) == 1
