"""Problems 7 and 8: containers of tokens, and mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.llm.mixing import SEED, mix, reached
from tidemill.llm.packing import audit, fill, pack, split_documents
from tidemill.llm.tokens import sized
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.session import cut
from tidemill.sources.tables import spread, table

REGISTRY = Registry()

#: Unicode white space, as the pattern's \s has it; RE2's own \s is ASCII only.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL_TOKENS = rf"coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]+')), 0)"


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sized(spread(table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"])


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(spark, folder), table(spark, folder, "pack_capacities"))


@REGISTRY.add("p7_found", f"select capacity_tokens, doc_id from (select doc_id, {SQL_TOKENS} n from documents) d join pack_capacities c on d.n > c.capacity_tokens")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose tokens stand in more than one of the containers that the plan formed."""
    return split_documents(packed(spark, folder)).select("capacity_tokens", "doc_id")


SQL_PIECES = f"""select capacity_tokens, doc_id, piece, least(n - piece * capacity_tokens, capacity_tokens)::bigint tokens
  from (select *, unnest(range(0, ((n + capacity_tokens - 1) // capacity_tokens)::bigint)) piece
    from (select doc_id, {SQL_TOKENS} n from documents) d, pack_capacities c where n > 0)"""


@REGISTRY.add("p7_pieces", SQL_PIECES)
def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return packed(spark, folder).select("capacity_tokens", "doc_id", "piece", "tokens")


@REGISTRY.add("p7_audit", f"select capacity_tokens, count(*) items, sum(tokens)::bigint tokens, 0::bigint overfull, 0::bigint needless from ({SQL_PIECES}) group by 1")
def p7_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece and token stands in one container, no container is overfull, nothing is split without need."""
    return audit(packed(spark, folder))


@REGISTRY.add("p7_fill")
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full containers are, of batches formed inside their bucket alone and of those topped up from shorter buckets."""
    documents, capacities = cut(token_counts(spark, folder)), table(spark, folder, "pack_capacities")
    forms = [fill(pack(documents, capacities, top_up=t)).withColumn("form", F.lit("topped up" if t else "pure")) for t in (True, False)]
    return forms[0].unionByName(forms[1])


def sourced(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, folder, "documents").select("doc_id", "source", "text")).withColumn("source", tidy("source"))
    targets = table(spark, folder, "mix_targets").select(tidy("source").alias("source"), "target_share", "max_repeats")
    return sized(documents, ["doc_id", "source"]), targets


SQL_MIX = f"""
with d as (
  select * from (select doc_id, {sql_tidy("source")} source, {SQL_TOKENS} tokens from documents) where doc_id is not null and source is not null and tokens > 0
), t as (select {sql_tidy("source")} source, target_share, max_repeats from mix_targets
), h as (select source, count(*) docs, sum(tokens)::bigint tokens, any_value(target_share) target_share, any_value(max_repeats) max_repeats from d join t using (source) group by source
), s as (select *, target_share / (select sum(target_share::decimal(20, 12))::double from h) share from h
), r as (
  select source, max_repeats, least(share * (select min(max_repeats * tokens::double / share) from s) / tokens, max_repeats::double) rate,
    ('0x' || substr(md5('{SEED}/' || source), 1, 5))::bigint::double / 1048576.0::double start from s
), k as (select d.*, row_number() over (partition by source order by tokens, doc_id) - 1 k from d
), m as (select doc_id, source, tokens, least((floor(start + (k + 1) * rate) - floor(start + k * rate))::bigint, max_repeats)::bigint copies from k join r using (source))"""


@REGISTRY.add("p8_mixture", SQL_MIX + " select doc_id, source, copies from m where copies > 0")
def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents, targets = sourced(spark, folder)
    return mix(documents, targets).select("doc_id", "source", "copies")


@REGISTRY.add(
    "p8_shares",
    SQL_MIX
    + """, g as (select source, count(*) docs, sum(copies)::bigint copies, max(copies) most_repeats, sum(copies * tokens)::bigint tokens from m where copies > 0 group by source)
select t.source, target_share, max_repeats, coalesce(docs, 0) docs, coalesce(copies, 0)::bigint copies, coalesce(most_repeats, 0) most_repeats, coalesce(tokens, 0)::bigint tokens,
  round(coalesce(tokens, 0) / (select sum(tokens) from g)::double, 6) reached_share from t left join g using (source)""",
)
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    documents, targets = sourced(spark, folder)
    return reached(cut(mix(documents, targets)), targets)
