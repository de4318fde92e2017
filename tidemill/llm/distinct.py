"""Problem 1: distinct customers, restaurants and menu items per day, city, payment method and combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import tidy
from tidemill.llm.bitmaps import bits_for, estimates, hashed, leveled
from tidemill.operators.sized import skew_join
from tidemill.operators.warehouse import surrogate_keys
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.session import cut, written
from tidemill.sources.tables import table

REGISTRY = Registry()
#: Relative standard error that every count is to keep.
ERROR = 0.01
DIMENSIONS = ["order_day", "delivery_city", "payment_method"]


def coded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, orders, bought): the combinations of day, city and method with codes, and rows that name them by code.

    groups is (gid, pid, order_day, delivery_city, payment_method); pid stands for city and method alone, and texts
    are '' for null. orders is (gid, pid, customer_id, restaurant_id), bought (gid, pid, menu_item_id), identifiers
    hashed. Menu items take the day, city and method of the rows of raw_orders with their order_id; items without
    such a row belong to no day and aren't counted. An order that came again is matched once for each day, city and
    method it names.
    """
    known = lambda c: F.coalesce(c, F.lit(""))
    orders = table(spark, folder, "raw_orders").select(
        tidy("order_id").alias("order_id"),
        known(F.to_date("order_time").cast("string")).alias("order_day"),
        known(tidy("delivery_city")).alias("delivery_city"),
        known(tidy("payment_method")).alias("payment_method"),
        hashed(tidy("customer_id")).alias("customer_id"),
        hashed(tidy("restaurant_id")).alias("restaurant_id"),
    )
    each = cut(orders.select(*DIMENSIONS).distinct())
    # a pair goes by the least code of its days, which are few
    numbered = surrogate_keys(each, "gid", DIMENSIONS).withColumn("gid", F.col("gid").cast("int"))
    groups = cut(numbered.withColumn("pid", F.min("gid").over(Window.partitionBy(*DIMENSIONS[1:]))))
    named = skew_join(orders, groups, DIMENSIONS, salt_from=F.xxhash64("order_id")).select("order_id", "gid", "pid", "customer_id", "restaurant_id")
    items = table(spark, folder, "raw_order_items").select(tidy("order_id").alias("order_id"), hashed(tidy("menu_item_id")).alias("menu_item_id"))
    bought = items.where("order_id is not null and menu_item_id is not null").join(named.select("order_id", "gid", "pid"), "order_id").drop("order_id")
    return groups, named.drop("order_id"), written(bought, "bought")


def most(rows: DataFrame, groups: DataFrame) -> tuple[int, int]:
    """Rows of the fullest day, and of all: bounds of how many identifiers a union within a day, and any, can hold."""
    counted = skew_join(rows.groupBy("gid").agg(F.count("*").alias("n")), groups.select("gid", "order_day"), ["gid"])
    row = counted.groupBy("order_day").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def partial_bitmaps(spark: SparkSession, folder: str, error: float = ERROR) -> tuple[DataFrame, DataFrame]:
    """(groups, parts): bitmaps of each day, city and method (level 0) and of each city and method (level 1).

    What is united within a day needs bits for the rows of the fullest day only; what is united over days has a
    second, larger bitmap per city and method. Both come from one pass, and either merges with later ones of its level.
    """
    groups, orders, bought = coded(spark, folder)

    def parts(rows: DataFrame, identifiers: list[str]) -> DataFrame:
        day, whole = most(rows, groups)
        levels = [(["gid"], {c: bits_for(day, error) for c in identifiers}), (["pid"], {c: bits_for(whole, error) for c in identifiers})]
        return leveled(rows, levels, True)

    return groups, parts(orders, ["customer_id", "restaurant_id"]).unionByName(parts(bought, ["menu_item_id"]))


def sql_bits(rows: str) -> str:
    """The size that ``bits_for`` gives for ``n`` of ``rows``, as SQL: a power of two from 1024 on."""
    ok = f"sqrt(b * (exp(n / b) - 1 - n / b)) / n <= {ERROR} and b * exp(-n / b) >= 25 and 1 / sqrt(2 * b) <= {ERROR}"
    return f"(select min(b)::bigint from (select greatest({rows}, 1)::double n), (select pow(2, i) b from range(10, 48) t(i)) where n / b < 700 and {ok})"


def _fullest(rows: str) -> str:
    return f"(select coalesce(max(c), 0) from (select count(*) c from {rows} group by order_day))"


SQL = f"""
with o as (
  select {sql_tidy("order_id")} order_id, order_time::date order_day, {sql_tidy("delivery_city")} delivery_city, {sql_tidy("payment_method")} payment_method,
    {sql_tidy("customer_id")} customer_id, {sql_tidy("restaurant_id")} restaurant_id from raw_orders
), i as (
  select order_day, delivery_city, payment_method, {sql_tidy("menu_item_id")} id from raw_order_items t join o on o.order_id = {sql_tidy("t.order_id")} where {sql_tidy("menu_item_id")} is not null
), z as (select {sql_bits(_fullest("o"))} od, {sql_bits("(select count(*) from o)")} oa, {sql_bits(_fullest("i"))} id_, {sql_bits("(select count(*) from i)")} ia
), a as (
  select order_day, delivery_city, payment_method, 'customer_id' identifier, od day_bits, oa all_bits, customer_id id from o, z
  union all select order_day, delivery_city, payment_method, 'restaurant_id', od, oa, restaurant_id from o, z
  union all select order_day, delivery_city, payment_method, 'menu_item_id', id_, ia, id from i, z
), h as (select distinct *, ('0x' || substr(md5(id), 1, 12))::bigint h from a where id is not null
), g as (
  select identifier, day_bits bits, order_day, delivery_city, payment_method, grouping(delivery_city, payment_method)::int combination, count(distinct h % day_bits) s
  from h group by identifier, day_bits, order_day, cube(delivery_city, payment_method)
  union all
  select identifier, all_bits, null, delivery_city, payment_method, 4 + grouping(delivery_city, payment_method)::int, count(distinct h % all_bits) from h group by identifier, all_bits, cube(delivery_city, payment_method)
)
select identifier, bits, strftime(order_day, '%Y-%m-%d') order_day, delivery_city, payment_method, combination, round(-bits * ln((bits - s) / bits::double))::bigint estimate,
  round(sqrt(bits * (bits / (bits - s)::double + ln((bits - s) / bits::double) - 1)) / (-bits * ln((bits - s) / bits::double)), 4) relative_error
from g"""


@REGISTRY.add("p1_distinct_counts", SQL)
def p1_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of every combination; ``combination`` has 4, 2 and 1 for day, city and method left out."""
    groups, parts = partial_bitmaps(spark, folder)
    pairs = groups.select("pid", *DIMENSIONS[1:]).distinct()
    within = estimates(parts.where("level = 0").drop("level", "pid"), ["order_day"], DIMENSIONS[1:], lambda df: skew_join(df, groups.drop("pid"), ["gid"]))
    across = estimates(parts.where("level = 1").drop("level", "gid"), [], DIMENSIONS[1:], lambda df: skew_join(df, pairs, ["pid"]))
    both = within.unionByName(across.withColumns({"combination": F.col("combination") + 4, "order_day": F.lit(None).cast("string")}))
    return both.withColumns({c: F.nullif(c, F.lit("")) for c in DIMENSIONS})
