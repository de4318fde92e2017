"""Feature tables as of the latest event: everything in one plan, the reference time included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.sized import skew_join


def recent(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to the latest ``at``, both ends included, with that time as event_timestamp.

    The reference time is a scalar subquery of the same plan; rows without a time are left out.
    """
    return df.sparkSession.sql(
        f"select d.*, (select max(`{at}`) from {{df}}) as event_timestamp from {{df}} d where `{at}` >= (select max(`{at}`) from {{df}}) - interval {int(days)} days", df=df
    )


def order_frequency(orders: DataFrame, days: int = 7, created: Column | None = None) -> DataFrame:
    """(customer_id, order_freq, event_timestamp, created) of customers with an order in the last days."""
    found = recent(orders.select("customer_id", "order_time"), "order_time", days).groupBy("customer_id", "event_timestamp").agg(F.count("*").alias("order_freq"))
    return found.select("customer_id", "order_freq", "event_timestamp", _created(created))


def preparation_time(orders: DataFrame, restaurants: DataFrame, days: int = 30, created: Column | None = None) -> DataFrame:
    """(restaurant_id, avg_prep_time, orders, event_timestamp, created): the dimension's time averaged over orders.

    Orders are counted per restaurant before they meet the dimension (one row a restaurant), so a busy one costs
    no more than others.
    """
    counted = recent(orders.select("restaurant_id", "order_time"), "order_time", days).groupBy("restaurant_id", "event_timestamp").agg(F.count("*").alias("n"))
    joined = skew_join(counted, restaurants.select("restaurant_id", "prep_time_minutes"), ["restaurant_id"])
    mean = F.sum(F.col("prep_time_minutes") * F.col("n")) / F.sum(F.when(F.col("prep_time_minutes").isNotNull(), F.col("n")))
    return joined.groupBy("restaurant_id", "event_timestamp").agg(F.round(mean, 2).alias("avg_prep_time"), F.sum("n").alias("orders")).select(
        "restaurant_id", "avg_prep_time", "orders", "event_timestamp", _created(created)
    )


def acceptance_rate(orders: DataFrame, days: int = 7, created: Column | None = None) -> DataFrame:
    """(driver_id, acceptance_rate, orders, event_timestamp, created): completed over assigned orders."""
    found = recent(orders.select("driver_id", "status", "order_time"), "order_time", days).where("driver_id is not null")
    rate = F.round(F.count_if(F.col("status") == "completed") / F.count("*"), 4)
    return found.groupBy("driver_id", "event_timestamp").agg(rate.alias("acceptance_rate"), F.count("*").alias("orders")).select("driver_id", "acceptance_rate", "orders", "event_timestamp", _created(created))


def _created(created: Column | None) -> Column:
    return (F.current_timestamp() if created is None else created).alias("created")
