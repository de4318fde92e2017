"""Filling containers: optimal length buckets, and batches by token budget formed in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import ranged, with_rank
from tidemill.session import cut as cut_lineage

#: Length buckets of each capacity.
BUCKETS = 128


def length_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets over a histogram of lengths, with the least padding there can be.

    Padding is the sum over items of their bucket's bound less their length. ``lengths`` rise. Dynamic
    programming over (bucket, length), exact; the split points never fall as the last length grows, so each
    layer is solved by halving, in O(n log n).
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    mass = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    cost = lengths * total[1:] - mass[1:]  # one bucket for the first j + 1 lengths
    cuts = np.zeros((buckets, n), np.int64)
    for k in range(1, buckets):
        head, new = np.concatenate([[0.0], cost[:-1]]), np.empty(n)
        # all halves of a level at once: each solves its middle over the cuts its neighbours leave it
        lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while lo.size:
            mid = (lo + hi) // 2
            width = np.minimum(b, mid) - a + 1
            start = np.concatenate([[0], np.cumsum(width)[:-1]])
            part, last = np.repeat(np.arange(mid.size), width), np.repeat(mid, width)
            at = np.arange(part.size) - (start - a)[part]  # the last bucket holds lengths at..last
            whole = head[at] + lengths[last] * (total[last + 1] - total[at]) - (mass[last + 1] - mass[at])
            best = np.minimum.reduceat(whole, start)
            hits = np.flatnonzero(whole == best[part])
            cut = at[hits[np.unique(part[hits], return_index=True)[1]]]
            new[mid], cuts[k, mid] = best, cut
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (a, cut), (cut, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        cost = new
    bounds, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        bounds.append(lengths[j])
        j = cuts[k, j] - 1
        if j < 0:
            break
    return np.array(bounds[::-1])


def batch_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int, top_up: bool = True) -> np.ndarray:
    """How the ranked items of each bucket form containers: rows of (bucket, first rank, per container, first container).

    A batch takes as many items of the longest bucket left as the budget holds at that bucket's bound; with
    ``top_up`` the rest of the budget goes to batches of shorter buckets in turn. Equal containers are planned
    at once, so the plan's size follows the number of buckets, not of items.
    """
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    plan, container = [], 0
    while left.any():
        room, take = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take[b] = min(int(left[b]), room // int(bounds[b]))
                room -= take[b] * int(bounds[b])
                if not top_up:
                    break
        times = min(int(left[b]) // m for b, m in take.items())
        for b, m in take.items():
            plan.append((b, used[b], m, container))
            used[b] += m * times
            left[b] -= m * times
        container += times
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, capacities: DataFrame, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """Put documents (doc_id, tokens) into containers of each capacity (capacity_tokens).

    Rows are (capacity_tokens, container_id, doc_id, piece, pieces, first_token, tokens, bucket_tokens). Only a
    document longer than the capacity is split: into pieces as long as the capacity and one shorter piece. Pieces are
    items like any other: they are counted in the histogram, fall into buckets and form batches by the plan
    (one as long as the capacity fills its container). Documents without tokens or id take no space and are
    left out, as are capacities that are null or under 1; a repeated capacity counts once, and a doc_id that
    occurs twice is two documents. A bucket holds any number of items: they are ranked over ranges of even
    size. To the driver come only the histogram of lengths (at most as many rows as the sum of capacities) and
    the capacities.
    """
    spark = documents.sparkSession
    sizes = [r[0] for r in capacities.where("capacity_tokens >= 1").select("capacity_tokens").distinct().orderBy("capacity_tokens").collect()]
    held = cut_lineage(documents.where("tokens > 0 and doc_id is not null").select("doc_id", F.col("tokens").cast("bigint").alias("all_tokens")))
    each = held.withColumn("capacity_tokens", F.explode(F.array(*[F.lit(c).cast("bigint") for c in sizes]) if sizes else F.array().cast("array<bigint>")))
    each = each.withColumns({"full": F.expr("all_tokens div capacity_tokens"), "rest": F.expr("all_tokens % capacity_tokens")})
    each = each.withColumn("pieces", F.col("full") + (F.col("rest") > 0).cast("bigint"))
    # counted without making the pieces: those as long as the capacity, and the shorter ones
    lengths_of = F.array(F.struct(F.col("capacity_tokens").alias("length"), F.col("full").alias("n")), F.struct(F.col("rest").alias("length"), F.lit(1).cast("bigint").alias("n")))
    counted = each.select("capacity_tokens", F.inline(lengths_of)).where("length > 0 and n > 0").groupBy("capacity_tokens", "length").agg(F.sum("n").alias("n"))
    histogram = counted.collect()
    bounds_of, plans = {}, {}
    for c in sizes:
        own = sorted((r["length"], r["n"]) for r in histogram if r["capacity_tokens"] == c)
        lengths, counts = np.array([x for x, _ in own], np.int64), np.array([n for _, n in own], np.int64)
        bounds = length_buckets(lengths, counts, buckets) if own else lengths
        bounds_of[c] = bounds
        plans[c] = batch_plan(bounds, np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)).astype(np.int64) if own else counts, c, top_up)
    buckets_of = [(int(r["capacity_tokens"]), int(r["length"]), int(b), int(bounds_of[r["capacity_tokens"]][b])) for r in histogram for b in [np.searchsorted(bounds_of[r["capacity_tokens"]], r["length"])]]
    # as many rows as the histogram, which the capacities bound
    lookup = F.broadcast(spark.createDataFrame(buckets_of, "capacity_tokens bigint, tokens bigint, bucket bigint, bucket_tokens bigint"))
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    items = pieces.withColumn("tokens", F.when(F.col("piece") < F.col("full"), F.col("capacity_tokens")).otherwise(F.col("rest"))).join(lookup, ["capacity_tokens", "tokens"])
    items = items.select("capacity_tokens", "bucket", "doc_id", "piece", "pieces", "tokens", "bucket_tokens")
    order = ["capacity_tokens", "bucket", "doc_id", "piece", "tokens", "pieces"]
    ranked = with_rank(ranged(items, order, rows=sum(r["n"] for r in histogram)), ["capacity_tokens", "bucket"], "rank")

    def placed(capacity: pa.Array, bucket: pa.Array, rank: pa.Array) -> pa.Array:
        cs, bs, rs = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (capacity, bucket, rank))
        out = np.zeros(len(cs), np.int64)
        for c in np.unique(cs):
            plan, rows = plans[int(c)], np.flatnonzero(cs == c)
            key = plan[:, 0] * (1 << 44) + plan[:, 1]
            at = plan[np.searchsorted(key, bs[rows] * (1 << 44) + rs[rows], side="right") - 1]
            out[rows] = at[:, 3] + (rs[rows] - at[:, 1]) // at[:, 2]
        return pa.array(out, pa.int64())

    batched = ranked.withColumns({"container_id": F.arrow_udf(placed, "bigint")("capacity_tokens", "bucket", "rank"), "first_token": F.expr("piece * capacity_tokens")})
    return batched.select("capacity_tokens", "container_id", "doc_id", "piece", "pieces", "first_token", "tokens", "bucket_tokens")


def split_documents(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id, containers_from, containers_to) of documents that stand in more than one container.

    As a document is split only if it exceeds the capacity, these are the longer ones; of two with one doc_id each has its row.
    """
    spans = packed.where("pieces > 1").groupBy("capacity_tokens", "doc_id").agg(
        F.min("container_id").alias("containers_from"), F.max("container_id").alias("containers_to"), F.count_if(F.col("piece") == 0).cast("int").alias("_documents")
    )
    return spans.where("containers_from < containers_to").withColumn("_documents", F.explode(F.array_repeat(F.lit(1), F.col("_documents")))).drop("_documents")


def audit(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, items, tokens, overfull, needless): what the containers hold, and what must be 0.

    overfull counts containers with more tokens than the capacity; needless counts pieces, but for a document's
    last, that don't fill a container.
    """
    one = packed.groupBy("capacity_tokens", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.count_if((F.col("piece") < F.col("pieces") - 1) & (F.col("tokens") < F.col("capacity_tokens"))).alias("needless"))
    return one.groupBy("capacity_tokens").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"), F.sum("needless").alias("needless"))


def fill(packed: DataFrame) -> DataFrame:
    """How well containers are filled, per capacity: containers, items, tokens, share of the space used, padding to buckets."""
    one = packed.groupBy("capacity_tokens", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("bucket_tokens").alias("padded"))
    return one.groupBy("capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * F.col("capacity_tokens")), 4).alias("fill_share"),
        F.round(F.sum("tokens") / F.sum("padded"), 4).alias("bucket_share"),
    )
