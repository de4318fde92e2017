"""Problem 2: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.operators.selection import dominant, quantiles
from tidemill.operators.sized import skew_join
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.sources.tables import table

REGISTRY = Registry()


def keyed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """raw_orders in long form: (field, key, order_time, total_amount, distance_km), rows without a key left out.

    The category is that of the restaurant's latest row.
    """
    orders = table(spark, folder, "raw_orders").select(
        tidy("restaurant_id").alias("restaurant_id"), tidy("delivery_city").alias("delivery_city"), "order_time", "total_amount", "distance_km"
    )
    restaurants = (
        table(spark, folder, "raw_restaurants")
        .select(tidy("restaurant_id").alias("restaurant_id"), tidy("category").alias("category"), "ingested_at")
        .where("restaurant_id is not null")
        .groupBy("restaurant_id")
        .agg(F.max_by("category", F.struct("ingested_at", "category")).alias("category"))
    )
    both = skew_join(orders, restaurants, ["restaurant_id"], "left", salt_from=F.xxhash64("order_time", "total_amount", "distance_km"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("key")) for c in ("delivery_city", "category")])
    return both.select(F.inline(fields), "order_time", "total_amount", "distance_km").where("key is not null")


SQL_KEYED = f"""
with c as (
  select id, last(category order by ingested_at nulls first, category nulls first) category
  from (select {sql_tidy("restaurant_id")} id, {sql_tidy("category")} category, ingested_at from raw_restaurants) where id is not null group by id
), k as (
  select 'delivery_city' field, {sql_tidy("delivery_city")} as "key", order_time, total_amount, distance_km from raw_orders
  union all
  select 'category', c.category, order_time, total_amount, distance_km from raw_orders o join c on c.id = {sql_tidy("o.restaurant_id")}
)"""


@REGISTRY.add(
    "p2_found",
    SQL_KEYED
    + """, p as (
  select field, 'all' period, "key" from k where "key" is not null
  union all
  select field, strftime(date_trunc('week', order_time), '%Y-%m-%d'), "key" from k where "key" is not null and order_time is not null
), c2 as (select field, period, "key", count(*) c from p group by all),
n as (select *, sum(c) over (partition by field, period) n from c2)
select field, period, "key" from n where case when period = 'all' then 5 * c >= n else 2 * c > n end""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    keyed = keyed_orders(spark, folder)
    day = F.to_date("order_time")
    week = F.date_sub(day, F.weekday(day)).cast("string")
    periods = keyed.select("field", "key", F.explode(F.array(F.lit("all"), week)).alias("period"))
    least = F.when(F.col("period") == "all", F.expr("(n + 4) div 5")).otherwise(F.expr("n div 2 + 1"))
    return dominant(periods, ["field", "period"], "key", least).select("field", "period", "key")


@REGISTRY.add(
    "p2_key_quantiles",
    SQL_KEYED
    + """, v as (
  select field, "key", 'total_amount' measure, total_amount::double v from k where "key" is not null and total_amount is not null
  union all
  select field, "key", 'distance_km', distance_km from k where "key" is not null and distance_km is not null
), r as (select *, row_number() over (partition by field, "key", measure order by v) rn, count(*) over (partition by field, "key", measure) n from v)
select field, "key", measure, n, max(v) filter (rn = greatest(ceil(0.5::double * n), 1)) q50, max(v) filter (rn = greatest(ceil(0.9::double * n), 1)) q90,
  max(v) filter (rn = greatest(ceil(0.99::double * n), 1)) q99
from r group by all""",
)
def p2_key_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    keyed = keyed_orders(spark, folder)
    values = F.create_map(F.lit("total_amount"), F.col("total_amount").cast("double"), F.lit("distance_km"), F.col("distance_km"))
    long = keyed.select("field", "key", F.explode(values).alias("measure", "v"))
    return quantiles(long, ["field", "key", "measure"], "v", [0.5, 0.9, 0.99])
