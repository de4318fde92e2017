"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import ranged, with_rank
from tidemill.session import cut

SEED = "mixture"


def rates(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate, start) of every target with tokens.

    The mixture is as large as the caps allow, or ``total_tokens`` if that is less; then no source needs more
    than ``max_repeats`` copies of a document on average, and rate is the copies expected of each. Targets
    without documents are left out and the other shares keep their proportions. A null, zero or negative share or
    cap means that the source isn't used; a source named twice counts with its greatest share. start is the
    source's random offset in [0, 1).
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("t"))
    held = documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).join(wanted.select("source", "t.*"), "source")
    held = cut(held)
    shares = held.agg(F.sum(F.col("target_share").cast("decimal(20,12)")).cast("double")).first()[0]
    if shares is None:
        return held.withColumns({"rate": F.lit(0.0), "start": F.lit(0.0)})
    share = F.col("target_share") / F.lit(shares)
    most = held.agg(F.min(F.col("max_repeats") * F.col("tokens") / share)).first()[0]
    size = most if total_tokens is None else min(most, float(total_tokens))
    start = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), "source").cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    return held.withColumns({"rate": F.least(share * F.lit(size) / F.col("tokens"), F.col("max_repeats").cast("double")), "start": start})


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The mixture of documents (doc_id, source, tokens): (doc_id, source, tokens, copies), copies at least 1.

    Within each source documents stand in the order of (tokens, doc_id); the prefix sum of their expected copies,
    shifted by one random offset, crosses an integer boundary for each copy. In that order every length is
    drawn in proportion, so shares of tokens come out as those of documents do. A source with a third of all
    rows is ranked over ranges of even size. Documents without id, tokens or a target aren't used.
    """
    usable = documents.where("doc_id is not null and source is not null and tokens > 0").select("doc_id", "source", "tokens")
    usable = cut(usable)
    weights = rates(usable, targets, total_tokens)
    placed = with_rank(ranged(usable, ["source", "tokens", "doc_id"]), ["source"], "rank").join(weights.select("source", "rate", "start", "max_repeats"), "source")
    edge = lambda r: F.floor(F.col("start") + r * F.col("rate"))
    copies = F.least(edge(F.col("rank") + 1) - edge(F.col("rank")), F.col("max_repeats").cast("bigint"))
    return placed.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: what it was to be and what it is; sources without a document in the mixture have 0."""
    got = mixture.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    total = got.agg(F.sum("tokens")).first()[0] or 1
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["docs", "copies", "most_repeats", "tokens"])
    return rows.withColumn("reached_share", F.round(F.col("tokens") / F.lit(float(total)), 6))
