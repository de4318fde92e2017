"""Drivers and reviews: no file holds them, so both are made from raw_orders by digest, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.plans.events import sql_tidy
from tidemill.sources.tables import table

VEHICLES = ["bicycle", "scooter", "electric scooter", "van"]


def _draw(c: Column, at: int, of: int) -> Column:
    """A number from 0 to ``of`` - 1 from four digits of the MD5, from the ``at``-th on."""
    return F.conv(F.substring(F.md5(c.cast("binary")), at, 4), 16, 10).cast("bigint") % of


def _sql_draw(c: str, at: int, of: int) -> str:
    return f"(('0x' || substr(md5({c}), {at}, 4))::bigint % {of})"


def drivers(spark: SparkSession, folder: str) -> DataFrame:
    """raw_drivers: one row for each driver that an order names, in the last by name of the cities it delivers to."""
    rows = table(spark, folder, "raw_orders").select(tidy("driver_id").alias("driver_id"), tidy("delivery_city").alias("city"), "ingested_at").where("driver_id is not null")
    known = rows.groupBy("driver_id").agg(F.max("city").alias("city"), F.max("ingested_at").alias("ingested_at"))
    d = F.col("driver_id")
    kind = F.element_at(F.array(*[F.lit(v) for v in VEHICLES]), (_draw(d, 1, len(VEHICLES)) + 1).cast("int"))
    return known.select("driver_id", F.concat(F.lit("Driver "), d).alias("name"), kind.alias("vehicle_type"), "city", ((_draw(d, 5, 21) + 30) / 10.0).alias("rating"), "ingested_at")


SQL_DRIVERS = f"""select driver_id, 'Driver ' || driver_id "name", (array[{', '.join(f"'{v}'" for v in VEHICLES)}])[{_sql_draw("driver_id", 1, len(VEHICLES))} + 1] vehicle_type,
  city, ({_sql_draw("driver_id", 5, 21)} + 30) / 10.0::double rating, ingested_at
  from (select {sql_tidy("driver_id")} driver_id, max({sql_tidy("delivery_city")}) city, max(ingested_at) ingested_at from raw_orders group by 1) where driver_id is not null"""


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """raw_reviews: of three in ten completed orders; one in fifty names restaurant rst000001, whichever the order's is."""
    rows = table(spark, folder, "raw_orders").where("status = 'completed'").select(tidy("order_id").alias("order_id"), tidy("customer_id").alias("customer_id"), tidy("restaurant_id").alias("restaurant_id"), "ingested_at")
    o = F.col("order_id")
    each = rows.where(o.isNotNull()).groupBy("order_id").agg(F.max("customer_id").alias("customer_id"), F.max("restaurant_id").alias("restaurant_id"), F.max("ingested_at").alias("ingested_at"))
    named = F.when(_draw(o, 5, 50) == 0, F.lit("rst000001")).otherwise(F.col("restaurant_id"))
    return each.where(_draw(o, 1, 10) < 3).select(F.concat(F.lit("rev-"), o).alias("review_id"), "order_id", "customer_id", named.alias("restaurant_id"), (_draw(o, 9, 5) + 1).alias("rating"), "ingested_at")


SQL_REVIEWS = f"""select 'rev-' || order_id review_id, order_id, customer_id, case when {_sql_draw("order_id", 5, 50)} = 0 then 'rst000001' else restaurant_id end restaurant_id,
  {_sql_draw("order_id", 9, 5)} + 1 rating, ingested_at
  from (select {sql_tidy("order_id")} order_id, max({sql_tidy("customer_id")}) customer_id, max({sql_tidy("restaurant_id")}) restaurant_id, max(ingested_at) ingested_at from raw_orders
    where status = 'completed' group by 1) where order_id is not null and {_sql_draw("order_id", 1, 10)} < 3"""

MADE = {"raw_drivers": drivers, "raw_reviews": reviews}
#: Both as common table expressions, to be put after ``with``.
SQL_MADE = f"raw_drivers as ({SQL_DRIVERS}), raw_reviews as ({SQL_REVIEWS})"


def bronze(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A raw table of the folder, or one of those made here."""
    return MADE[name](spark, folder) if name in MADE else table(spark, folder, name)
