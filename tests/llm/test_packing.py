from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidemill.llm.packing import audit, batch_plan, fill, length_buckets, pack, split_documents


@pytest.mark.parametrize("seed", range(4))
def test_buckets_are_the_best_there_are(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
    counts = np.array([rng.randint(1, 50) for _ in lengths])
    padding = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
    for k in (1, 2, 4, 8):
        best = min(padding([*some, lengths[-1]]) for some in itertools.combinations(lengths[:-1], k - 1))
        got = length_buckets(lengths, counts, k)
        assert len(got) <= k and padding(got) == best


def test_plans_place_every_item_once_and_keep_the_budget():
    rng = random.Random(5)
    bounds = np.array(sorted(rng.sample(range(1, 101), 12)))
    counts = np.array([rng.randint(0, 300) for _ in bounds])
    for top_up in (True, False):
        plan = batch_plan(bounds, counts, 100, top_up)
        load = {}
        for b in range(12):
            rows = plan[plan[:, 0] == b]
            for rank in range(counts[b]):
                row = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
                c = row[3] + (rank - row[1]) // row[2]
                load[c] = load.get(c, 0) + bounds[b]
        assert max(load.values()) <= 100
        assert sorted(load) == list(range(len(load)))
    assert batch_plan(np.zeros(0, int), np.zeros(0, int), 10).shape == (0, 4)


def brute_checks(rows, sizes):
    for c in {r["capacity_tokens"] for r in rows}:
        mine = [r for r in rows if r["capacity_tokens"] == c]
        loads, pieces = {}, {}
        for r in mine:
            loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"], r["pieces"]))
        assert max(loads.values()) <= c
        for doc, ps in pieces.items():
            ps.sort()
            assert [p[0] for p in ps] == list(range(ps[0][3]))
            assert (len(ps) > 1) == (sizes[doc] > c)
            assert [p[1] for p in ps] == list(itertools.accumulate([0, *[p[2] for p in ps[:-1]]]))
            assert sum(p[2] for p in ps) == sizes[doc]
        assert set(pieces) == {d for d, n in sizes.items() if n > 0}


def test_pack_with_ties_long_documents_nulls_and_a_hot_length(spark):
    rng = random.Random(3)
    sizes = {i: 7 if i % 3 else rng.choice([0, 1, 64, 65, 128, 1000, rng.randint(1, 300)]) for i in range(1, 600)}
    rows = [*sizes.items(), (None, 5), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    caps = spark.createDataFrame([(64, "a"), (64, "b"), (200, None), (None, "x"), (0, "y"), (-5, "z")], "capacity_tokens long, label string")
    got = pack(df, caps, buckets=8).collect()
    assert {r["capacity_tokens"] for r in got} == {64, 200}
    brute_checks(got, sizes)
    both = pack(df, caps, buckets=8)
    assert {(r["capacity_tokens"], r["doc_id"]) for r in split_documents(both).collect()} == {(c, d) for c in (64, 200) for d, n in sizes.items() if n > c}
    assert {(r["capacity_tokens"], r["tokens"], r["overfull"], r["needless"]) for r in audit(both).collect()} == {(c, sum(sizes.values()), 0, 0) for c in (64, 200)}
    assert {r["capacity_tokens"]: r["fill_share"] > 0.8 for r in fill(pack(df, caps)).collect()} == {64: True, 200: True}


def test_pack_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    caps = spark.createDataFrame([(64,)], "capacity_tokens long")
    assert pack(empty, caps).collect() == []
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), caps.limit(0)).collect() == []
    assert fill(pack(empty, caps)).collect() == split_documents(pack(empty, caps)).collect() == audit(pack(empty, caps)).collect() == []
