"""Profiles, checks and governance over the raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, micros_to_ntz, tidy
from tidemill.operators import checks, governance, profile
from tidemill.operators.features import acceptance_rate, order_frequency, preparation_time
from tidemill.plans.events import sql_clock, sql_tidy
from tidemill.plans.derived import SQL_MADE, bronze
from tidemill.plans.gold import REGISTRY as GOLD
from tidemill.plans.gold import SQL_STG, as_of, dimension, latest, stg_orders
from tidemill.plans.registry import Registry
from tidemill.plans.relational import SQL_LATEST, latest_orders
from tidemill.sources.specs import SPECS
from tidemill.sources.tables import spread, table

REGISTRY = Registry()

#: Expected weights of cities, to hold shares against.
WEIGHTS = [("lam tuyen", 0.45), ("hoa kiet", 0.30), ("dong sa loc", 0.10), ("bac trieu khe", 0.04), ("phu vanh", 0.035), ("ninh oai", 0.03), ("cat vong", 0.025), ("suoi mac", 0.02)]
SQL_WEIGHTS = "(values " + ", ".join(f"('{c}', {w}::double)" for c, w in WEIGHTS) + ") w(v, weight)"


@REGISTRY.add(
    "skew_report",
    f"""select value, "rows", pct, round(weight * 100.0::double / (select sum(weight) from {SQL_WEIGHTS}), 2) expected_pct, round(pct - round(weight * 100.0::double / (select sum(weight) from {SQL_WEIGHTS}), 2), 2) diff_pp
from (select {sql_tidy("delivery_city")} value, count(*) "rows", round(count(*) * 100.0::double / sum(count(*)) over (), 2) pct from raw_orders group by 1) left join {SQL_WEIGHTS} on v = value""",
)
def skew_report(spark: SparkSession, folder: str) -> DataFrame:
    cities = table(spark, folder, "raw_orders").select(tidy("delivery_city").alias("city"))
    return profile.share_report(cities, "city", spark.createDataFrame(WEIGHTS, "value string, weight double"))


CARD = ["order_id", "customer_id", "restaurant_id", "driver_id", "status", "payment_method"]


@REGISTRY.add(
    "cardinality_report",
    " union all ".join(f"select 'raw_orders' \"table\", '{c}' \"column\", count(distinct {c}) n_distinct, count(*) total, round(count(distinct {c}) / count(*), 4) ratio, case when count(distinct {c}) > 1000 then 'HIGH' else 'LOW' end \"level\" from raw_orders" for c in CARD),
)
def cardinality_report(spark: SparkSession, folder: str) -> DataFrame:
    """By raw spelling, as the reference does; ``cardinality_report_tidy`` compares tidied."""
    return profile.cardinality_report(table(spark, folder, "raw_orders"), "raw_orders", CARD)


@REGISTRY.add("approximate_report")
def approximate_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.approximate_report(table(spark, folder, "raw_orders"), CARD[:4], 0.02)


SQL_VERSION = "case when ingested_at < timestamp '2026-04-20' then 'v1' else 'v2' end"


@REGISTRY.add(
    "null_profile",
    " union all ".join(f"select {SQL_VERSION} version, '{c}' \"column\", count(*) \"rows\", count(*) filter ({c} is null) nulls, round(count(*) filter ({c} is null) * 100.0::double / count(*), 2) null_pct from raw_menu_items group by 1" for c in ("spice_level", "restaurant_id", "category")),
)
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    version = F.when(F.col("ingested_at") < F.lit("2026-04-20").cast("timestamp_ntz"), "v1").otherwise("v2")
    return profile.null_report(table(spark, folder, "raw_menu_items"), version, ["spice_level", "restaurant_id", "category"])


@REGISTRY.add(
    "defect_report",
    f"""with {SQL_MADE}, o as ({SQL_LATEST}), s as (select order_id, sum(subtotal)::bigint t from raw_order_items group by order_id),
k as (select {sql_tidy("order_id")} order_id, last({sql_tidy("restaurant_id")} order by ingested_at nulls first, {sql_tidy("restaurant_id")} nulls first) expected from raw_orders where {sql_tidy("order_id")} is not null group by 1)
select 'total_amount is the sum of its items' "check", count(*) filter (total_amount is null or t is null or total_amount <> t) violations, count(*) of_rows,
  round(count(*) filter (total_amount is null or t is null or total_amount <> t) * 100.0::double / count(*), 3) pct from o left join s using (order_id)
union all
select 'cancelled orders have a reason', count(*) filter (cancelled_reason_code is null), count(*), round(count(*) filter (cancelled_reason_code is null) * 100.0::double / greatest(count(*), 1), 3) from o where status = 'cancelled'
union all
select 'reviews name their order''s restaurant', count(*) filter (restaurant_id is distinct from expected), count(*), round(count(*) filter (restaurant_id is distinct from expected) * 100.0::double / greatest(count(*), 1), 3)
  from raw_reviews join k using (order_id)""",
)
def defect_report(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and reasons of the latest orders, and the restaurants that reviews name."""
    base = profile.defect_report(latest_orders(spark, folder), table(spark, folder, "raw_order_items"))
    orders = table(spark, folder, "raw_orders").select(tidy("order_id").alias("order_id"), tidy("restaurant_id").alias("restaurant_id"), "ingested_at").where("order_id is not null")
    return base.unionByName(profile.review_report(bronze(spark, folder, "raw_reviews"), orders.groupBy("order_id").agg(F.max_by("restaurant_id", F.struct("ingested_at", "restaurant_id")).alias("restaurant_id"))))


SQL_PCT = lambda a, b, d=2: f"round(case when {b} > 0 then ({a}) * 100.0::double / ({b}) else 0.0 end, {d})"


@REGISTRY.add(
    "outlier_report",
    f"""with o as ({SQL_LATEST}), j as (select quantity >= 4 bulk, hour(order_time) in (11, 12, 13) lunch, isodow(order_time) <= 5 weekday, quantity from raw_order_items left join o using (order_id))
select count(*) "rows", count(*) filter (bulk) bulk_rows, {SQL_PCT("count(*) filter (bulk)", "count(*)", 3)} bulk_pct, {SQL_PCT("count(*) filter (bulk and lunch)", "count(*) filter (bulk)")} lunch_pct,
  {SQL_PCT("count(*) filter (bulk and weekday)", "count(*) filter (bulk)")} weekday_pct, max(quantity) max_quantity from j""",
)
def outlier_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.outlier_report(table(spark, folder, "raw_order_items"), latest_orders(spark, folder), 4)


@REGISTRY.add("hour_histogram", """select hour(order_time)::int "hour", count(*) "rows", round(count(*) * 100.0::double / sum(count(*)) over (), 2) pct from raw_orders group by 1 order by "rows" desc, "hour" limit 10""")
def hour_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.hour_histogram(table(spark, folder, "raw_orders"), "order_time")


def timed_events(spark: SparkSession, folder: str) -> DataFrame:
    """raw_delivery_events with both clocks in microseconds and tidy keys."""
    columns = ["event_id", "order_id", "driver_id", "event_type", "lat", "lon", "sequence_number", "city", "event_time", "sent_at", "_kafka_partition", "_kafka_offset"]
    return spread(table(spark, folder, "raw_delivery_events").select(*columns)).select(
        tidy("event_id").alias("event_id"), tidy("order_id").alias("order_id"), tidy("driver_id").alias("driver_id"), "event_type", "lat", "lon", "sequence_number", tidy("city").alias("city"),
        clock_micros("event_time").alias("event_us"), clock_micros("sent_at").alias("sent_us"), "_kafka_partition", "_kafka_offset",
    )


SQL_TIMED = f"""select {sql_tidy("event_id")} event_id, {sql_tidy("order_id")} order_id, {sql_tidy("driver_id")} driver_id, event_type, lat, lon, sequence_number, {sql_tidy("city")} city,
  {sql_clock("event_time")} event_us, {sql_clock("sent_at")} sent_us, _kafka_partition, _kafka_offset from raw_delivery_events"""


@REGISTRY.add(
    "late_report",
    f"""select count(*) events, count(*) filter (d > 5000000) late, {SQL_PCT("count(*) filter (d > 5000000)", "count(*)")} late_pct, (sum(d) filter (d > 5000000) // count(*) filter (d > 5000000) // 1000)::bigint mean_delay_ms, max(d) filter (d > 5000000) // 1000 max_delay_ms
from (select sent_us - event_us d from ({SQL_TIMED}) where event_us is not null and sent_us is not null)""",
)
def late_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.late_report(timed_events(spark, folder))


@REGISTRY.add(
    "stream_duplicate_report",
    f"""select sum(n)::bigint messages, count(*) unique_keys, sum(n - 1)::bigint extra_copies, count(*) filter (n > 1) repeated_keys, round(sum(n - 1) * 100.0::double / count(*), 3) dup_pct
from (select event_id, count(*) n from ({SQL_TIMED}) where event_id is not null group by 1)""",
)
def stream_duplicate_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.copies_report(timed_events(spark, folder), "event_id")


SQL_BURST = f"select hour(make_timestamp(event_us))::int \"hour\", count(*) events, round(count(*) * 100.0::double / sum(count(*)) over (), 2) pct, hour(make_timestamp(event_us)) in (11, 12, 13, 18, 19, 20) is_peak from ({SQL_TIMED}) where event_us is not null group by hour(make_timestamp(event_us))"


def _hour():
    return F.hour(micros_to_ntz(F.col("event_us")))


@REGISTRY.add("burst_report", SQL_BURST)
def burst_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.burst_report(timed_events(spark, folder), _hour())


@REGISTRY.add("burst_ratio", f"select avg(events) filter (is_peak) peak_avg, avg(events) filter (not is_peak) normal_avg, round(avg(events) filter (is_peak) / avg(events) filter (not is_peak), 2) ratio from ({SQL_BURST})")
def burst_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return profile.burst_ratio(profile.burst_report(timed_events(spark, folder), _hour()))


@REGISTRY.add(
    "ordering_report",
    f"""with l as (select order_id, sequence_number, lag(sequence_number) over (partition by order_id order by sent_us nulls first, _kafka_partition, _kafka_offset) b from ({SQL_TIMED}) where order_id is not null),
g as (select order_id, count(*) n, bool_or(coalesce(b > sequence_number, false)) falls from l group by 1)
select count(*) keys, count(*) filter (falls) disordered, {SQL_PCT("count(*) filter (falls)", "count(*)")} pct from g where n >= 2""",
)
def ordering_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.order_report(timed_events(spark, folder), "order_id", "sequence_number", ["sent_us", "_kafka_partition", "_kafka_offset"])


DIMS = ["event_type", "city", "_kafka_partition"]


@REGISTRY.add("stream_counts", " union all ".join(f"select '{c}' dimension, {c}::varchar value, count(*) \"rows\" from ({SQL_TIMED}) group by 2" for c in DIMS))
def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.counts_by(timed_events(spark, folder), DIMS)


@REGISTRY.add(
    "topic_partitions",
    "select _kafka_partition, count(*) messages, max(_kafka_offset) last_offset from raw_delivery_events group by 1",
)
def topic_partitions(spark: SparkSession, folder: str) -> DataFrame:
    from tidemill.sources.scan import per_partition

    return per_partition(table(spark, folder, "raw_delivery_events"))


def sql_checks(name: str) -> str:
    s = SPECS[name]
    others = [c for c in s.required if c != s.key]
    nulls = " + ".join(f"count(*) filter ({c} is null)" for c in others)
    pct = f"case when count(distinct {s.key}) > 0 then (count({s.key}) - count(distinct {s.key})) * 100.0::double / count(distinct {s.key}) else 0 end"
    head = f"select '{name}' \"table\","
    named = f"(select unnest(json_keys(to_json(t))) k from (from {name} limit 1) t)"
    gone = f"{len(s.required)} - count(*) filter (k in ({', '.join(f"'{c}'" for c in s.required)}))"
    return " union all ".join(
        [
            f"{head} 'schema' \"check\", {gone} = 0 passed, 'critical' severity, ({gone})::double value, '' detail from {named}",
            f"{head} 'rows', count(*) >= {s.min_rows}, case when count(*) = 0 then 'critical' else 'warning' end, count(*)::double, 'at least {s.min_rows}' from {name}",
            f"{head} 'nulls', count(*) filter ({s.key} is null) + {nulls} = 0, case when count(*) filter ({s.key} is null) > 0 then 'critical' else 'warning' end, (count(*) filter ({s.key} is null) + {nulls})::double, '{s.key}' from {name}",
            f"{head} 'duplicates', {pct} <= 5.0, 'warning', round({pct}, 3), 'at most 5.0 %' from {name}",
        ]
    )


SQL_CHECKS = " union all ".join(f"({sql_checks(n)})" for n in SPECS)


@REGISTRY.add("bronze_checks", f"with {SQL_MADE} {SQL_CHECKS}")
def bronze_checks(spark: SparkSession, folder: str) -> DataFrame:
    """By raw spelling, and a blank is not null, as in the reference; ``bronze_checks_tidy`` compares tidied."""
    return reduce(DataFrame.unionByName, [checks.check_table(bronze(spark, folder, n), s) for n, s in SPECS.items()])


@REGISTRY.add("required_nulls", f"with {SQL_MADE} " + " union all ".join(f"select '{n}' \"table\", '{c}' \"column\", count(*) \"rows\", count(*) filter ({c} is null) nulls from {n}" for n, s in SPECS.items() for c in s.required))
def required_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [checks.null_counts(bronze(spark, folder, n), s) for n, s in SPECS.items()])


@REGISTRY.add(
    "bronze_summary",
    f"""with {SQL_MADE} select count(distinct "table") tables, sum(case when "check" = 'rows' then value end)::bigint total_rows, count(*) filter (passed) passed,
  count(*) filter (not passed and severity = 'warning') warnings, count(*) filter (not passed and severity = 'critical') criticals from ({SQL_CHECKS})""",
)
def bronze_summary(spark: SparkSession, folder: str) -> DataFrame:
    return checks.summarise(bronze_checks(spark, folder))


FEATURES = {"feat_customer_order_freq_7d": "customer_id", "feat_restaurant_avg_prep_time_30d": "restaurant_id", "feat_driver_acceptance_rate_7d": "driver_id"}


@REGISTRY.add(
    "feature_checks",
    " union all ".join(
        f"select '{n}' \"name\", count(*) \"rows\", count(*) filter ({e} is null) null_entities, count(event_timestamp) = count(*) and count(created) = count(*) has_times, count(*) > 0 and count(*) filter ({e} is null) = 0 passed from ({GOLD.sql[n]})"
        for n, e in FEATURES.items()
    ),
)
def feature_checks(spark: SparkSession, folder: str) -> DataFrame:
    orders = stg_orders(spark, folder)
    made = {"feat_customer_order_freq_7d": order_frequency(orders, 7, as_of()), "feat_restaurant_avg_prep_time_30d": preparation_time(orders, latest(spark, folder, "restaurant"), 30, as_of()), "feat_driver_acceptance_rate_7d": acceptance_rate(orders, 7, as_of())}
    return reduce(DataFrame.unionByName, [checks.check_features(made[n], e, n) for n, e in FEATURES.items()])


def _frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "bronze.raw_orders": table(spark, folder, "raw_orders"),
        "gold.dim_customer": dimension(spark, folder, "customer"),
        "gold.feat_customer_order_freq_7d": order_frequency(stg_orders(spark, folder), 7, as_of()),
    }


_asserted = [("bronze.raw_orders", "order_id", "raw_orders"), ("gold.dim_customer", "customer_sk", "d"), ("gold.dim_customer", "is_current", "d"), ("gold.feat_customer_order_freq_7d", "event_timestamp", "f"), ("gold.feat_customer_order_freq_7d", "created", "f")]
SQL_ASSERTED = f"with d as ({GOLD.sql['dim_customer_first_load']}), f as ({GOLD.sql['feat_customer_order_freq_7d']}), a as (" + " union all ".join(
    f"select '{n}' dataset, '{c}' \"column\", count(*) \"rows\", count(*) filter ({c} is null) nulls, count(*) filter ({c} is null) = 0 passed from {t}" for n, c, t in _asserted
) + ")"


@REGISTRY.add("assertion_status", SQL_ASSERTED + " select * from a")
def assertion_status(spark: SparkSession, folder: str) -> DataFrame:
    return governance.assertions(_frames(spark, folder))


@REGISTRY.add("contract_status", SQL_ASSERTED + ' select dataset, count(*) assertions, count(*) filter (not passed) failed, bool_and(passed) passed from a group by dataset')
def contract_status(spark: SparkSession, folder: str) -> DataFrame:
    return governance.contracts(governance.assertions(_frames(spark, folder)))


#: Written out by hand, so that the queries are held against something that isn't made from them.
SQL_LINEAGE = """with src(n) as (values ('customer'), ('restaurant'), ('driver'), ('order'), ('order_item'), ('menu_item'), ('review'), ('gps-topic')),
raw(n) as (values ('raw_orders'), ('raw_order_items'), ('raw_menu_items'), ('raw_reviews'), ('raw_customers'), ('raw_restaurants'), ('raw_drivers'), ('raw_delivery_events')),
stg(n) as (values ('stg_orders'), ('stg_delivery_events')),
star(n) as (values ('dim_customer'), ('dim_restaurant'), ('dim_driver'), ('dim_menu_item'), ('fact_orders'), ('fact_delivery_events'), ('fact_order_items')),
feat(n) as (values ('feat_customer_order_freq_7d'), ('feat_restaurant_avg_prep_time_30d'), ('feat_driver_acceptance_rate_7d')),
edges as (
  select 'ingest' pipeline, 'source.' || src.n upstream, 'bronze.' || raw.n downstream from src, raw
  union all select 'transform', 'bronze.' || raw.n, 'silver.' || stg.n from raw, stg
  union all select 'transform', 'bronze.' || raw.n, 'gold.' || star.n from raw, star
  union all select 'features', 'gold.' || star.n, 'gold.' || feat.n from star, feat
)"""


@REGISTRY.add("lineage_edges", SQL_LINEAGE + " from edges")
def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    return governance.lineage(spark)


@REGISTRY.add("lineage_counts", "select * from (values ('ingest', 8, 8), ('transform', 8, 9), ('features', 7, 3)) t(pipeline, reads, writes)")
def lineage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return governance.lineage_counts(spark)


@REGISTRY.add("registered_datasets", SQL_LINEAGE + " select n dataset, split_part(n, '.', 1) layer from (select upstream n from edges union select downstream from edges)")
def registered_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return governance.datasets(spark)


@REGISTRY.add(
    "stream_statistics",
    f"""with t as ({SQL_TIMED}), d as (select *, sent_us - event_us d from t)
select count(*) messages, count(distinct event_id) unique_keys, count(event_id) - count(distinct event_id) extra_copies, count(distinct order_id) orders, count(distinct driver_id) drivers, count(d) timed,
  count(*) filter (d > 5000000) late, trunc(min(d) / 1000)::bigint least_delay_ms, trunc(max(d) / 1000)::bigint most_delay_ms from d""",
)
def stream_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Messages, copies, lateness and delays of the topic in one row."""
    return profile.stream_statistics(timed_events(spark, folder))
