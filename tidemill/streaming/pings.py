"""Speed of drivers per window of event time: one meaning, as a batch plan and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.functions.geo import haversine_km
from tidemill.functions.text import tidy
from tidemill.operators.ordered import RANGE_ROWS, ranged, with_neighbour
from tidemill.session import cut

WINDOW_US = 300_000_000
#: What a message of the topic holds.
MESSAGE = T.StructType(
    [
        T.StructField(c, t)
        for c, t in (
            ("event_id", T.StringType()),
            ("order_id", T.StringType()),
            ("driver_id", T.StringType()),
            ("event_type", T.StringType()),
            ("lat", T.DoubleType()),
            ("lon", T.DoubleType()),
            ("event_time", T.StringType()),
            ("sent_at", T.StringType()),
            ("sequence_number", T.IntegerType()),
            ("city", T.StringType()),
        )
    ]
)


def window_start(us: Column, size: int = WINDOW_US) -> Column:
    return us - F.pmod(us, F.lit(size))


def _speed(km: Column, span_us: Column) -> Column:
    return F.when(span_us > 0, km / (span_us / 3_600_000_000.0)).otherwise(0.0)


def window_speed(pings: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(more, window_end_us, driver_id, pings, km, span_us, avg_speed_kmh) per driver and window with two or more pings.

    ``pings`` has driver_id, event_us, sequence_number, event_id, lat, lon, and the further keys ``more``; rows without
    driver or time are left out. Pings of a window follow each other by (event_us, sequence_number, event_id); the
    speed is the length of the path over the time from the first to the last, 0 if that is no time; a step from or
    to a missing position counts as 0 km. Five minutes of one driver are few pings by nature; windows that are
    counted to hold more than ``RANGE_ROWS`` are worked off over ranges instead, so none is gathered in one place.
    """
    keys, order = [*(more or []), "driver_id", "_w"], ["event_us", "sequence_number", "event_id", "lat", "lon"]
    rows = cut(pings.where("driver_id is not null and event_us is not null").select(*(more or []), "driver_id", window_start(F.col("event_us")).alias("_w"), *order))
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > RANGE_ROWS).drop("_n"))
    place = Window.partitionBy(*keys).orderBy(*order)
    near = lambda df: df.withColumn("_before", F.struct(F.lag("lat").over(place).alias("lat"), F.lag("lon").over(place).alias("lon")))
    if large.isEmpty():
        out = _paths(near(rows), keys)
    else:
        # one row for a million pings or more
        few, many = rows.join(F.broadcast(large), keys, "left_anti"), rows.join(F.broadcast(large), keys, "left_semi")
        out = _paths(near(few), keys).unionByName(_paths(with_neighbour(ranged(many, [*keys, *order]), keys, ["lat", "lon"], "_before"), keys))
    return out.where("pings >= 2").select(*(more or []), (F.col("_w") + WINDOW_US).alias("window_end_us"), "driver_id", "pings", "km", "span_us", _speed(F.col("km"), F.col("span_us")).alias("avg_speed_kmh"))


def _paths(pairs: DataFrame, keys: list[str]) -> DataFrame:
    km = F.coalesce(haversine_km(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return pairs.groupBy(*keys).agg(F.count("*").alias("pings"), F.sum(km).alias("km"), (F.max("event_us") - F.min("event_us")).alias("span_us"))


def with_top(pings: DataFrame, arrival: list[str]) -> DataFrame:
    """``pings`` with ``_top``, the greatest event time up to each of them in ``arrival`` order.

    The running maximum is taken per range and carried over ranges (one row a range).
    """
    placed = ranged(pings, arrival)
    here = F.max("event_us").over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    tops = placed.groupBy("_range").agg(F.max("event_us").alias("_most"))
    carried = tops.select("_range", F.max("_most").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    seen = placed.withColumn("_here", here).join(F.broadcast(carried), "_range")
    return seen.select(*pings.columns, F.greatest("_here", "_carried").alias("_top"))


def in_time(tolerance_us: Column) -> Column:
    """Whether a ping comes in time for its window: its end is after ``_top`` less the tolerance."""
    return (window_start(F.col("event_us")) + WINDOW_US) > F.col("_top") - tolerance_us


def kept_by_watermark(pings: DataFrame, tolerance_us: int, arrival: list[str]) -> DataFrame:
    """``pings`` without those that come too late for their window, record by record in ``arrival`` order.

    A ping is dropped iff its window's end is at or before the greatest event time seen so far less the tolerance.
    """
    return with_top(pings, arrival).where(in_time(F.lit(tolerance_us))).drop("_top")


def stream_windows(pings: DataFrame, tolerance: str = "5 minutes", dedup: str | None = "within_watermark") -> DataFrame:
    """The same windows over a streaming frame with TIMESTAMP event_time, in append mode.

    ``dedup``: None; ``within_watermark`` forgets an identifier once the watermark has passed it; ``exact`` never
    does, and its state grows with the stream. Messages without event_id are nobody's copies and all stay. A window's pings are gathered in the state of its driver until it
    closes.
    """
    marked = pings.where("driver_id is not null and event_time is not null").withWatermark("event_time", tolerance)
    # a stand-in for no identifier; its seed is drawn anew for each micro-batch, so it never comes again
    known = marked.withColumn("_id", F.coalesce(tidy("event_id"), F.uuid()))
    if dedup == "within_watermark":
        marked = known.dropDuplicatesWithinWatermark(["_id"])
    elif dedup == "exact":
        marked = known.dropDuplicates(["_id"])
    elif dedup is not None:
        raise ValueError(f"no such way to deduplicate: {dedup}")
    point = F.struct(F.unix_micros("event_time").alias("t"), F.col("sequence_number").alias("n"), F.col("event_id").alias("id"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    grouped = marked.groupBy(F.window("event_time", "5 minutes").alias("_w"), "driver_id").agg(F.array_sort(F.collect_list(point)).alias("_p"))
    steps = F.zip_with(
        F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.coalesce(haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]), F.lit(0.0))
    )
    km = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    shaped = grouped.where(F.size("_p") >= 2).select(
        F.unix_micros("_w.end").alias("window_end_us"), "driver_id", F.size("_p").cast("bigint").alias("pings"), km.alias("km"), (F.element_at("_p", -1)["t"] - F.element_at("_p", 1)["t"]).alias("span_us")
    )
    return shaped.withColumn("avg_speed_kmh", _speed(F.col("km"), F.col("span_us")))
