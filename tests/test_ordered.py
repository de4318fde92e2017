from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators.ordered import ranged, with_neighbour, with_rank


def test_neighbours_and_ranks_over_ranges_equal_windows(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 11}", (i * 7919) % 1000, i) for i in range(900)] + [(None, 1, 900), (None, 2, 901)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    placed = ranged(df, ["k", "t", "i"], range_rows=50)
    assert placed.select("_range").distinct().count() > 4
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    want = {}
    for rs in by.values():
        for n, r in enumerate(rs):
            want[r[2]] = (rs[n - 1][2] if n else None, rs[n + 1][2] if n + 1 < len(rs) else None)
    both = with_neighbour(with_neighbour(placed, ["k"], ["i"], "before"), ["k"], ["i"], "after", after=True)
    got = {r["i"]: (r["b"], r["a"]) for r in both.select("i", F.col("before.i").alias("b"), F.col("after.i").alias("a")).collect()}
    assert got == want
    ranks = {r["i"]: r["rank"] for r in with_rank(placed.where("k is not null"), ["k"], "rank").collect()}
    assert ranks == {r[2]: n for k, rs in by.items() if k for n, r in enumerate(rs)}
    assert sorted(r["rank"] for r in with_rank(placed, [], "rank").collect()) == list(range(902))


def test_empty(spark):
    placed = ranged(spark.createDataFrame([], "k string, t int"), ["k", "t"])
    assert with_neighbour(placed, ["k"], ["t"], "before").collect() == []
    assert with_rank(placed, ["k"], "rank").collect() == []
