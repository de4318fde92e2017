"""Made-up data with known defects, as Spark expressions: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours of the two daily peaks, and the shares of orders in each of them.
PEAKS = ((10, 11, 12), (17, 18, 19, 20))
PEAK_SHARES = (0.28, 0.36)
STATUS = {"completed": 0.8, "cancelled": 0.12, "failed": 0.08}
PAYMENT = {"cash": 0.5, "ewallet": 0.3, "bank_transfer": 0.2}
VEHICLE = {"bicycle": 0.25, "scooter": 0.6, "van": 0.15}
#: Each place and kind of food is half as frequent as the one before.
CITY = {name: 0.5**k for k, name in enumerate(("Northport", "Eastmere", "Southwick", "Westhaven", "Midvale", "Lakeside"))}
CATEGORY = {name: 0.5**k for k, name in enumerate(("noodles", "rice", "drinks", "grill", "bakery"))}
REASONS = {"customer": "changed their mind", "kitchen": "sold out", "courier": "nobody free"}
#: What a wrong total is off by.
DRIFTS = (-30_000, -10_000, 5_000, 20_000)


@dataclass(frozen=True)
class Volume:
    """Numbers of rows and rates of defects."""

    customers: int = 1000
    restaurants: int = 100
    drivers: int = 50
    menu_items: int = 500
    orders: int = 5000
    days: int = 180
    duplicate_rate: float = 0.02
    amount_mismatch: float = 0.003
    null_email: float = 0.03
    bad_phone: float = 0.01
    cross_city: float = 0.03
    review_rate: float = 0.30
    wrong_review: float = 0.02
    vip_weight: int = 3
    late_rate: float = 0.08
    stream_duplicate_rate: float = 0.015

    def scaled(self, factor: float) -> Volume:
        """All numbers of rows times ``factor``, at least 10."""
        return replace(self, **{f.name: max(10, int(getattr(self, f.name) * factor)) for f in fields(self) if f.name in ("customers", "restaurants", "drivers", "menu_items", "orders")})


def uniform(seed: str, *of: Column) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """A key drawn with its weight (weights are normalised)."""
    total, upto, out = sum(weights.values()), 0.0, None
    for key, w in weights.items():
        upto += w / total
        out = F.when(u < upto, key) if out is None else out.when(u < upto, key)
    return out.otherwise(list(weights)[-1])


def humped(seed: str, low: float, high: float, *of: Column, skew_right: bool = False) -> Column:
    """A number between low and high, mostly in the middle (or towards high)."""
    three = [uniform(f"{seed}{k}", *of) for k in range(3)]
    return F.lit(low) + F.lit(high - low) * (F.greatest(*three) if skew_right else reduce(lambda a, b: a + b, three) / 3)


def whole(u: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(u * (high - low + 1)) + low).cast("bigint")


def code(prefix: str, width: int, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def chosen(df: DataFrame, rate: float, total: int, seed: str, key: str) -> DataFrame:
    """Exactly round(total * rate) rows, those with the least hash of ``key``."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(round(total * rate))


def _id(seed: str, n: Column) -> Column:
    h = F.md5(F.concat(F.lit(seed), n.cast("string")).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _at(start: str, days: int, u: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.floor(u * days).cast("int"))


START = "2026-01-20 00:00:00"


def district(city: Column, u: Column) -> Column:
    """A district of the city: its name and a number from 1 to 5."""
    return F.concat_ws(" ", city, F.lit("district"), whole(u, 1, 5).cast("string"))


def phone(v: Volume, seed: str, n: Column) -> Column:
    return F.when(uniform(f"{seed}phone", n) < v.bad_phone, F.lit("n/a")).otherwise(code("09", 8, whole(uniform(f"{seed}digits", n), 0, 99_999_999)))


def is_vip(n: Column) -> Column:
    return uniform("segment", n) < 0.1


def customers(spark: SparkSession, v: Volume) -> DataFrame:
    n = F.col("id")
    city = weighted(uniform("city", n), CITY)
    return spark.range(v.customers).select(
        _id("customer", n).alias("customer_id"), F.concat_ws(" ", F.lit("Name"), n.cast("string")).alias("name"), phone(v, "c", n).alias("phone"),
        F.when(uniform("email", n) >= v.null_email, F.concat(F.lit("c"), n, F.lit("@example.org"))).alias("email"), city.alias("city"), district(city, uniform("district", n)).alias("district"),
        _at("2024-01-01 00:00:00", 700, uniform("signup", n)).alias("signup_date"), F.when(is_vip(n), "vip").otherwise("regular").alias("segment"), F.lit(START).cast("timestamp_ntz").alias("ingested_at"),
    )


def restaurants(spark: SparkSession, v: Volume) -> DataFrame:
    n = F.col("id")
    city = weighted(uniform("rcity", n), CITY)
    return spark.range(v.restaurants).select(
        code("RST", 6, n).alias("restaurant_id"), F.concat(F.lit("Kitchen "), n).alias("name"), city.alias("city"), district(city, uniform("rdistrict", n)).alias("district"),
        weighted(uniform("category", n), CATEGORY).alias("category"), F.round(humped("rating", 2.5, 5.0, n, skew_right=True), 1).alias("rating"), whole(uniform("open", n), 5, 10).alias("open_hour"),
        whole(uniform("close", n), 20, 23).alias("close_hour"), whole(humped("prep", 0, 1, n), 10, 45).alias("prep_time_minutes"), F.lit(START).cast("timestamp_ntz").alias("ingested_at"),
    )


def drivers(spark: SparkSession, v: Volume) -> DataFrame:
    n = F.col("id")
    return spark.range(v.drivers).select(
        code("DRV", 6, n).alias("driver_id"), F.concat(F.lit("Driver "), n).alias("name"), phone(v, "d", n).alias("phone"), weighted(uniform("vehicle", n), VEHICLE).alias("vehicle_type"), weighted(uniform("dcity", n), CITY).alias("city"),
        _at("2023-01-01 00:00:00", 900, uniform("since", n)).alias("active_since"), F.round(humped("drating", 3.0, 5.0, n, skew_right=True), 1).alias("rating"), F.lit(START).cast("timestamp_ntz").alias("ingested_at"),
    )


def menu_items(spark: SparkSession, v: Volume, version: int = 1) -> DataFrame:
    """Version 2 has the column spice_level, null for most items."""
    n = F.col("id")
    out = spark.range(v.menu_items).select(
        code("MNU", 7, n).alias("menu_item_id"), code("RST", 6, n % v.restaurants).alias("restaurant_id"), F.concat(F.lit("Dish "), n).alias("name"), weighted(uniform("mcategory", n), CATEGORY).alias("category"),
        (whole(uniform("price", n), 15, 120) * 1000).alias("price"), (uniform("available", n) < 0.95).alias("is_available"), F.lit(START).cast("timestamp_ntz").alias("ingested_at"),
    )
    return out if version == 1 else out.withColumn("spice_level", F.when(uniform("spice", F.col("menu_item_id")) < 0.2, whole(uniform("level", F.col("menu_item_id")), 0, 5).cast("double")))


def order_hour(n: Column) -> Column:
    """An hour of the first peak, of the second, or one of the others from 6 to 23, by ``PEAK_SHARES``."""
    others = [h for h in range(6, 24) if h not in PEAKS[0] + PEAKS[1]]
    u, w = uniform("period", n), uniform("hour", n)
    pick = lambda hours: F.element_at(F.array(*[F.lit(h) for h in hours]), (F.floor(w * len(hours)) + 1).cast("int"))
    return F.when(u < PEAK_SHARES[0], pick(PEAKS[0])).when(u < sum(PEAK_SHARES), pick(PEAKS[1])).otherwise(pick(others))


def buyer(v: Volume, n: Column) -> Column:
    """Whose order it is: of up to ``vip_weight`` draws the first that is a VIP, else the last."""
    draws = [whole(uniform(f"who{k}", n), 0, v.customers - 1) for k in range(v.vip_weight)]
    return reduce(lambda rest, d: F.when(is_vip(d), d).otherwise(rest), reversed(draws[:-1]), draws[-1])


def orders(spark: SparkSession, v: Volume) -> DataFrame:
    """One row an order, delivered in its customer's city but for ``cross_city``; totals are filled in by ``with_totals``."""
    n, who = F.col("id"), F.col("_who")
    status, at = weighted(uniform("status", n), STATUS), _at(START, v.days, uniform("day", n)) + F.make_dt_interval(F.lit(0), order_hour(n), whole(uniform("minute", n), 0, 59).cast("int"))
    unassigned = (status == "cancelled") & (uniform("unassigned", n) < 0.4)
    city = F.when(uniform("cross", n) < v.cross_city, weighted(uniform("ocity", n), {c: 1.0 for c in CITY})).otherwise(weighted(uniform("city", who), CITY))
    reason = F.when(status == "cancelled", weighted(uniform("reason", n), {c: 1.0 for c in REASONS}))
    rows = spark.range(v.orders).withColumn("_who", buyer(v, n)).select(
        code("ORD", 9, n).alias("order_id"), _id("customer", who).alias("customer_id"), code("RST", 6, whole(uniform("where", n), 0, v.restaurants - 1)).alias("restaurant_id"),
        F.when(~unassigned, code("DRV", 6, whole(uniform("driver", n), 0, v.drivers - 1))).alias("driver_id"), at.alias("order_time"), status.alias("status"), weighted(uniform("pay", n), PAYMENT).alias("payment_method"),
        city.alias("delivery_city"), F.round(humped("km", 0.3, 15.0, n), 2).alias("distance_km"), reason.alias("cancelled_reason_code"),
        F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[reason].alias("cancelled_reason_text"),
    )
    o = F.col("order_id")
    minutes = lambda seed, low, high: F.make_dt_interval(F.lit(0), F.lit(0), whole(uniform(seed, o), low, high).cast("int"))
    planned = F.col("order_time") + minutes("arrive", 15, 60)
    return rows.withColumns({"estimated_delivery_time": planned, "actual_delivery_time": F.when(F.col("status") == "completed", planned + minutes("delay", -10, 25)), "ingested_at": planned})


def order_items(spark: SparkSession, v: Volume) -> DataFrame:
    """One to four items an order; a few rows of 13 or more pieces."""
    n, k = F.col("id"), F.col("k")
    each = spark.range(v.orders).select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), whole(uniform("items", n), 1, 4))).alias("k"))
    quantity = F.when(uniform("bulk", n, k) < 0.005, whole(uniform("many", n, k), 13, 40)).otherwise(whole(uniform("few", n, k), 1, 3))
    price = whole(uniform("cost", n, k), 15, 120) * 1000
    out = each.select(code("OIT", 10, n * 4 + k - 1).alias("order_item_id"), code("ORD", 9, n).alias("order_id"), code("MNU", 7, whole(uniform("dish", n, k), 0, v.menu_items - 1)).alias("menu_item_id"), quantity.alias("quantity"), price.alias("unit_price"))
    return out.withColumns({"subtotal": F.col("quantity") * F.col("unit_price"), "ingested_at": F.lit(START).cast("timestamp_ntz")})


def with_totals(placed: DataFrame, items: DataFrame, v: Volume) -> DataFrame:
    """Orders with the sum of their items as total, 0 for none, off by some thousands at the rate of mismatches."""
    sums = items.groupBy("order_id").agg(F.sum("subtotal").alias("_sum"))
    drift = F.when(uniform("drift", F.col("order_id")) < v.amount_mismatch, F.element_at(F.array(*[F.lit(x) for x in DRIFTS]), whole(uniform("which", F.col("order_id")), 1, len(DRIFTS)).cast("int"))).otherwise(0)
    return placed.join(sums, "order_id", "left").withColumn("total_amount", F.greatest(F.coalesce("_sum", F.lit(0)) + drift, F.lit(0).cast("bigint"))).drop("_sum")


def reviews(placed: DataFrame, v: Volume) -> DataFrame:
    """Of a share of completed orders; a few name another restaurant."""
    n = F.col("order_id")
    wrong = uniform("wrong", n) < v.wrong_review
    return placed.where((F.col("status") == "completed") & (uniform("review", n) < v.review_rate)).select(
        F.concat(F.lit("REV"), F.substring("order_id", 4, 9)).alias("review_id"), "order_id", "customer_id", F.when(wrong, code("RST", 6, whole(uniform("other", n), 0, v.restaurants - 1))).otherwise(F.col("restaurant_id")).alias("restaurant_id"), whole(uniform("stars", n), 1, 5).alias("rating"), F.col("ingested_at")
    )


def with_duplicates(placed: DataFrame, v: Volume) -> DataFrame:
    """All orders and copies of a share of them, ingested up to ten minutes later."""
    again = chosen(placed, v.duplicate_rate, v.orders, "again", "order_id")
    return placed.unionByName(again.withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval(secs=whole(uniform("later", F.col("order_id")), 1, 599).cast("decimal(18,6)"))))


def delivery_events(spark: SparkSession, v: Volume) -> DataFrame:
    """Pings of every assigned order: picked up, on the way every 30 s, delivered; some late, some sent twice."""
    trips = orders(spark, v).where("driver_id is not null").select("order_id", "driver_id", "order_time", F.col("delivery_city").alias("city"), whole(humped("trip", 0, 1, F.col("order_id")), 10, 60).alias("_last"))
    pings = trips.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("sequence_number", "_n"))
    key = [F.col("order_id"), F.col("sequence_number")]
    at = F.col("order_time") + F.make_dt_interval(secs=(F.col("sequence_number") * 30).cast("decimal(18,6)"))
    late = F.when(uniform("late", *key) < v.late_rate, whole(uniform("delay", *key), 30, 420)).otherwise(whole(uniform("soon", *key), 0, 2))
    kind = F.when(F.col("sequence_number") == 0, "PICKED_UP").when(F.col("sequence_number") == F.col("_last"), "DELIVERED").otherwise("EN_ROUTE")
    share = F.col("sequence_number") / F.col("_last")
    event = pings.select(
        _id("event", F.concat_ws("/", *key)).alias("event_id"), "order_id", "driver_id", kind.alias("event_type"), F.round(10.7 + share * uniform("lat", F.col("order_id")) * 0.1, 6).alias("lat"),
        F.round(106.6 + share * uniform("lon", F.col("order_id")) * 0.1, 6).alias("lon"), at.alias("_at"), late.alias("_late"), "sequence_number", "city", (uniform("twice", *key) < v.stream_duplicate_rate).alias("_twice"), whole(uniform("copy", *key), 1, 29).alias("_copy"),
    )
    delays = F.when(F.col("_twice"), F.array(F.col("_late"), F.col("_late") + F.col("_copy"))).otherwise(F.array("_late"))
    sent = event.select("*", F.explode(delays).alias("_delay"))
    return sent.select(
        "event_id", "order_id", "driver_id", "event_type", "lat", "lon", F.replace(F.col("_at").cast("string"), F.lit(" "), F.lit("T")).alias("event_time"),
        F.replace((F.col("_at") + F.make_dt_interval(secs=F.col("_delay").cast("decimal(18,6)"))).cast("string"), F.lit(" "), F.lit("T")).alias("sent_at"), "sequence_number", "city",
    )


def everything(spark: SparkSession, v: Volume | None = None) -> dict[str, DataFrame]:
    """All raw tables, duplicates last."""
    v = v or Volume()
    items = order_items(spark, v)
    placed = with_totals(orders(spark, v), items, v)
    return {
        "raw_customers": customers(spark, v),
        "raw_restaurants": restaurants(spark, v),
        "raw_drivers": drivers(spark, v),
        "raw_menu_items": menu_items(spark, v, 2),
        "raw_order_items": items,
        "raw_reviews": reviews(placed, v),
        "raw_orders": with_duplicates(placed, v),
        "raw_delivery_events": delivery_events(spark, v),
    }
