from __future__ import annotations

from datetime import datetime, timedelta

from tidemill.operators.history import Layout, append, change_counts, first_load, paired, split_by_rate, view

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, at timestamp_ntz, a string, b string, p int"
TYPES = {"a": "string", "b": "string"}


def shown(found):
    return sorted(((r["k"], r["valid_from"], r["valid_to"], r["is_current"], r["a"], r["b"]) for r in found.collect()), key=repr)


def build(spark, rows, groups=None, range_rows=20):
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = paired(df, "k", "at", ["a", "b"], ["p"], range_rows)
    layout = Layout("k", "at", groups or split_by_rate(change_counts(pairs, ["a", "b"])), ["p"])
    seen, sats = first_load(pairs, layout)
    return layout, seen, sats, shown(view(sats, layout, TYPES, range_rows))


def test_versions_equal_brute_force_with_a_hot_key(spark):
    rows = []
    for i in range(400):
        k = "hot" if i % 2 else f"k{i % 9}"
        rows.append((k, T0 + timedelta(hours=(i * 37) % 151), [None, "x", "y"][(i // 5) % 3], "b" if i % 50 else "c", i % 4))
    rows += [(None, T0, "x", "b", 1), ("k1", None, "x", "b", 1), rows[0]]
    best = {}
    for k, at, a, b, p in rows:
        if k and at:
            rank = (p, a is not None, a or "", b)
            if (k, at) not in best or rank > best[k, at][0]:
                best[k, at] = (rank, (a, b))
    want, by = [], {}
    for (k, at), (_, s) in sorted(best.items()):
        if not by.get(k) or by[k][-1][1] != s:
            by.setdefault(k, []).append((at, s))
    for k, vs in by.items():
        for n, (at, s) in enumerate(vs):
            end = vs[n + 1][0] if n + 1 < len(vs) else None
            want.append((k, at, end, end is None, *s))
    want.sort(key=repr)
    # over ranges and by key, whatever the satellites
    assert build(spark, rows)[3] == build(spark, rows, range_rows=10**6)[3] == want
    assert build(spark, rows, [["a", "b"]])[3] == build(spark, rows, [["a"], ["b"]])[3] == want
    # load by load in any order, each over a store that is only added to
    for shift in (1, 3):
        parts = [[r for i, r in enumerate(rows) if (i // 60 * shift) % 4 == n] for n in range(4)]
        parts = [p for p in parts if p]
        layout, seen, sats, _ = build(spark, parts[0], [["b"], ["a"]])
        for part in parts[1:]:
            more = append(seen, sats, spark.createDataFrame(part, SCHEMA), layout, 20)
            assert all(m.columns == o.columns for m, o in zip(more, (seen, sats), strict=True))
            seen, sats = (spark.createDataFrame(o.unionByName(m).collect(), o.schema) for m, o in zip(more, (seen, sats), strict=True))
        assert shown(view(sats, layout, TYPES, 20)) == want
    again = append(seen, sats, spark.createDataFrame(parts[0], SCHEMA), layout)
    assert shown(view(sats.unionByName(again[1]), layout, TYPES)) == want


def test_null_is_a_state_and_empty_is_empty(spark):
    rows = [("k", T0, None, "b", 1), ("k", T0 + timedelta(1), "", "b", 1), ("k", T0 + timedelta(2), None, "b", 1)]
    assert len(build(spark, rows)[3]) == 3
    layout, seen, sats, none = build(spark, [])
    assert none == []
    assert len(append(seen, sats, spark.createDataFrame(rows, SCHEMA), layout)[0].collect()) == 3


def test_split_by_rate():
    assert split_by_rate({"a": 10, "b": 12, "c": 100}) == [["a", "b"], ["c"]]
    assert split_by_rate({"a": 0}) == [["a"]]
