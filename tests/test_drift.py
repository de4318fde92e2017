from __future__ import annotations

import itertools
import json
import random

import pytest

from tidemill.operators.drift import best_matching, changes, unified

SCHEMA = "file_id long, feed_id string, file_no int, line_no int, record string, v string"


def frame(spark, files):
    rows, fid = [], 0
    for (feed, no), records in files.items():
        fid += 1
        rows += [(fid, feed, no, k, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for k, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, files):
    return {(r["feed_id"], r["file_no"], r["field"], r["change"], r["new_field"]) for r in changes(frame(spark, files)).collect()}


def item(i, **more):
    return {"menu_item_id": f"M{i}", **more}


def test_changes_of_every_kind(spark):
    files = {
        ("F", 1): [item(1, price=5, spice=1, old=True), item(2, price=6, spice=None), "{broken", None, "[1]", item(1, price=5, spice=1, old=True)],
        ("F", 2): [item(1, price=5.0, heat=1), item(" m2 ", price=7, heat=3), item("2", price=7, heat=3)],  # spice -> heat, price double, old gone
        ("F", 4): [item(1, price=None, heat="1", Price=5), item(2, price=None, heat="2", Price=7)],  # a gap in the numbers; price null keeps its type
        ("F", 5): [item(1, price=5, heat=True, Price=5), item(2, price=6, heat="x", Price=7)],  # boolean and string together are string
        ("G", 1): [item(1, a=1)],
        ("G", 2): [],
        ("G", 3): ["nothing readable"],
        ("G", 4): [item(1, a=1)],
    }
    assert found(spark, files) == {
        ("f", 2, "spice", "renamed", "heat"),
        ("f", 2, "price", "type_changed", ""),
        ("f", 2, "old", "removed", ""),
        ("f", 4, "Price", "added", ""),
        ("f", 4, "heat", "type_changed", ""),
        ("f", 5, "price", "type_changed", ""),
        ("g", 3, "a", "removed", ""),
        ("g", 3, "menu_item_id", "removed", ""),
        ("g", 4, "a", "added", ""),
        ("g", 4, "menu_item_id", "added", ""),
    }


def test_rename_needs_more_than_half_of_the_same_type(spark):
    half = {("F", 1): [item(i, a=i) for i in range(4)], ("F", 2): [item(i, b=i if i < 2 else 9) for i in range(4)]}
    assert found(spark, half) == {("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")}
    typed = {("F", 1): [item(i, a=i) for i in range(4)], ("F", 2): [item(i, b=str(i)) for i in range(4)]}
    assert found(spark, typed) == {("f", 2, "a", "removed", ""), ("f", 2, "b", "added", "")}
    most = {("F", 1): [item(i, a=i, c=True, e="x") for i in range(4)], ("F", 2): [item(i, b=i if i else 9, d=True, f="x") for i in range(4)]}
    assert found(spark, most) == {("f", 2, "a", "renamed", "b"), ("f", 2, "c", "renamed", "d"), ("f", 2, "e", "renamed", "f")}


def test_long_values_many_records_and_empty(spark):
    long = "x" * 300_000
    files = {("F", 1): [item(i, a=long + str(i)) for i in range(3)], ("F", 2): [item(i, b=long + str(i)) for i in range(3)]}
    assert found(spark, files) == {("f", 2, "a", "renamed", "b")}
    assert changes(spark.createDataFrame([], SCHEMA)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None, None), (1, "F", None, 1, "{}", None)], SCHEMA)
    assert changes(nulls).collect() == []


def test_any_field_may_be_the_key(spark):
    rows = lambda name: [{"the sku": f" S{i}", name: f"v{i}"} for i in range(4)]
    df = frame(spark, {("F", 1): rows("a"), ("F", 2): rows("b")})
    assert {(r["field"], r["change"], r["new_field"]) for r in changes(df, "the sku").collect()} == {("a", "renamed", "b")}
    assert {r["item"] for r in unified(df, changes(df, "the sku"), "the sku").collect()} == {"s0", "s1", "s2", "s3"}
    assert {(r["field"], r["change"]) for r in changes(df).collect()} == {("a", "removed"), ("b", "added")}


def test_unified_follows_chains(spark):
    files = {("F", 1): [item(1, a=1)], ("F", 2): [item(1, b=1), item(1, b=1)], ("F", 3): [item(1, c=1)], ("F", 4): [item(1, a="new", c=1)]}
    df = frame(spark, files)
    got = {r["file_no"]: r["fields"] for r in unified(df.drop("v"), changes(df)).collect()}
    assert got[1] == {"menu_item_id": "M1", "a": "1"} and got[2] == got[1] and got[3] == got[1]
    assert unified(df, changes(df)).count() == 4


@pytest.mark.parametrize("seed", range(5))
def test_matching_equals_brute_force(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 5)
    w = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
    got = best_matching(w)
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used))
    slots = [*range(m), *[-1] * n]
    best = max(sum(w[i][j] for i, j in enumerate(p) if j >= 0) for p in set(itertools.permutations(slots, n)))
    assert abs(sum(w[i][j] for i, j in enumerate(got) if j >= 0) - best) < 1e-9
