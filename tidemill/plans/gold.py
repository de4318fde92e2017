"""The staged tables, dimensions, facts, features and their constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.operators import features, star
from tidemill.operators.dedup import keep_best
from tidemill.operators.ordered import ranged, with_neighbour
from tidemill.operators.warehouse import foreign_key_violations, look_up, merge_versions, primary_key_violations, version_invariants
from tidemill.plans.derived import SQL_DRIVERS, bronze
from tidemill.plans.events import sql_clock, sql_tidy
from tidemill.plans.registry import Registry
from tidemill.plans.relational import sql_best
from tidemill.session import cut
from tidemill.sources.tables import table

REGISTRY = Registry()
AS_OF = "2026-07-20 00:00:00"

def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def stg_orders(spark: SparkSession, folder: str) -> DataFrame:
    return star.stage_orders(table(spark, folder, "raw_orders"))


SQL_STG = sql_best("(select " + ", ".join(f"{sql_tidy(c)} {c}" if c in star.ORDER_KEYS else c for c in star.STAGED_ORDER) + ", ingested_at from raw_orders)", "order_id", ["ingested_at"], star.STAGED_ORDER)

EVENTS = star.STAGED_EVENT


def stg_events(spark: SparkSession, folder: str) -> DataFrame:
    return star.stage_events(table(spark, folder, "raw_delivery_events"))


def unkeyed_events(spark: SparkSession, folder: str) -> DataFrame:
    return star.unkeyed_events(table(spark, folder, "raw_delivery_events"))


SQL_STG_EVENTS = f"""select {', '.join(EVENTS)} from (
  select *, row_number() over (partition by event_id order by sequence_number nulls first, sent_us nulls first, _kafka_partition, _kafka_offset) rn from (
    select {sql_tidy("event_id")} event_id, {sql_tidy("order_id")} order_id, {sql_tidy("driver_id")} driver_id, event_type, make_timestamp({sql_clock("event_time")}) event_time,
      lat, lon, sequence_number, {sql_clock("sent_at")} sent_us, _kafka_partition, _kafka_offset from raw_delivery_events
  ) where event_id is not null) where rn = 1"""

SQL_UNKEYED = f"""select {', '.join(EVENTS)} from (
  select {sql_tidy("event_id")} event_id, {sql_tidy("order_id")} order_id, {sql_tidy("driver_id")} driver_id, event_type, make_timestamp({sql_clock("event_time")}) event_time,
    lat, lon, sequence_number from raw_delivery_events) where event_id is null"""

#: Dimension: (table, what the latest row is by).
DIMS = {"customer": ("raw_customers", ["snapshot_ts", "ingested_at"]), "restaurant": ("raw_restaurants", ["ingested_at"]), "driver": ("raw_drivers", ["ingested_at"]), "menu_item": ("raw_menu_items", ["ingested_at"])}


def latest(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The latest state of each key of a dimension."""
    return star.latest_rows(bronze(spark, folder, DIMS[name][0]), name)


def dimension(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return star.dimension(bronze(spark, folder, DIMS[name][0]), name, as_of())


def sql_latest(name: str) -> str:
    source, by = DIMS[name]
    key, columns = f"{name}_id", star.DIMENSIONS[name]
    cols = ", ".join(f"{sql_tidy(c)} {c}" if c in star.TIDY else f'"{c}"' for c in columns)
    inner = f"(select {sql_tidy(key)} {key}, {cols}, {', '.join(f'{c} _by{i}' for i, c in enumerate(by))} from {f'({SQL_DRIVERS})' if name == 'driver' else source})"
    return sql_best(inner, key, [f"_by{i}" for i in range(len(by))], [key, *columns], f"{key} is not null")


def sql_dim(name: str) -> str:
    return f"select row_number() over (order by {name}_id) {name}_sk, *, timestamp '{AS_OF}' valid_from_ts, null::timestamp valid_to_ts, true is_current from ({sql_latest(name)})"


REGISTRY.add("stg_orders", SQL_STG)(stg_orders)
REGISTRY.add("stg_delivery_events", SQL_STG_EVENTS)(stg_events)
REGISTRY.add("stg_delivery_events_unkeyed", SQL_UNKEYED)(unkeyed_events)


def _register_dimension(name: str) -> None:
    @REGISTRY.add(f"dim_{name}_first_load", sql_dim(name))
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return dimension(spark, folder, name)


for _name in star.DIMENSIONS:
    _register_dimension(_name)


FACT = star.FACT_ORDER


def fact_orders(spark: SparkSession, folder: str) -> DataFrame:
    return star.fact_orders(stg_orders(spark, folder), {n: dimension(spark, folder, n) for n in ("customer", "restaurant", "driver")})


SQL_DIMS = ", ".join(f"d_{n} as ({sql_dim(n)})" for n in star.DIMENSIONS)
_looked_up = " ".join(f"left join (select {n}_id, {n}_sk from d_{n}) using ({n}_id)" for n in ("customer", "restaurant", "driver"))
SQL_FACT = f"with stg as ({SQL_STG}), {SQL_DIMS}, fact as (select {', '.join(FACT)} from stg {_looked_up})"

REGISTRY.add("fact_orders", SQL_FACT + " select * from fact")(fact_orders)


def sql_fact_events(events: str) -> str:
    return f"with {SQL_DIMS}, e as ({events}) select event_id, order_id, driver_sk, event_type, event_time, lat, lon, sequence_number from e left join (select driver_id, driver_sk from d_driver) using (driver_id)"


@REGISTRY.add("fact_delivery_events", sql_fact_events(SQL_STG_EVENTS))
def fact_delivery_events(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed events; those without event_id are in ``fact_delivery_events_unkeyed``."""
    return star.fact_events(stg_events(spark, folder), dimension(spark, folder, "driver"))


@REGISTRY.add("fact_delivery_events_unkeyed", sql_fact_events(SQL_UNKEYED))
def fact_delivery_events_unkeyed(spark: SparkSession, folder: str) -> DataFrame:
    return star.fact_events(unkeyed_events(spark, folder), dimension(spark, folder, "driver"))


def fact_items(spark: SparkSession, folder: str) -> DataFrame:
    return star.fact_items(table(spark, folder, "raw_order_items"), dimension(spark, folder, "menu_item"))


_item = ["order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "subtotal"]
_once = sql_best("(select " + ", ".join(f"{sql_tidy(c)} {c}" if c.endswith("_id") else c for c in _item) + ", ingested_at from raw_order_items)", "order_item_id", ["ingested_at"], _item, "order_item_id is not null")
SQL_ITEMS = f"select {', '.join(star.FACT_ITEM)} from ({_once}) left join (select menu_item_id, menu_item_sk from d_menu_item) using (menu_item_id)"
REGISTRY.add("fact_order_items", f"with {SQL_DIMS} {SQL_ITEMS}")(fact_items)


@REGISTRY.add("star_query", SQL_FACT + " select category, count(*) orders, sum(total_amount)::bigint amount from fact join d_restaurant using (restaurant_sk) group by category order by orders desc, category")
def star_query(spark: SparkSession, folder: str) -> DataFrame:
    """The star join on a surrogate key, as SQL over views; each dimension is numbered once, and only those it needs."""
    dim = dimension(spark, folder, "restaurant")
    facts = look_up(stg_orders(spark, folder), dim, "restaurant_id", "restaurant_sk", "order_id")
    return spark.sql(
        "select d.category, count(*) as orders, sum(f.total_amount) as amount from {f} f join {d} d on f.restaurant_sk = d.restaurant_sk group by d.category order by orders desc, category", f=facts, d=dim
    )


def gold_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven tables of the star, each kept in the shared folder, so that many checks read what one plan made."""
    dims = {n: cut(dimension(spark, folder, n)) for n in star.DIMENSIONS}
    return {f"dim_{n}": d for n, d in dims.items()} | {
        "fact_orders": cut(star.fact_orders(stg_orders(spark, folder), dims)),
        "fact_delivery_events": cut(star.fact_events(stg_events(spark, folder), dims["driver"])),
        "fact_order_items": cut(star.fact_items(table(spark, folder, "raw_order_items"), dims["menu_item"])),
    }


SQL_GOLD = (
    SQL_FACT
    + f", dim_customer as (from d_customer), dim_restaurant as (from d_restaurant), dim_driver as (from d_driver), dim_menu_item as (from d_menu_item), fact_orders as (from fact), e as ({SQL_STG_EVENTS}),"
    + f" fact_delivery_events as (select {', '.join(star.FACT_EVENT)} from e left join (select driver_id, driver_sk from d_driver) using (driver_id)), fact_order_items as ({SQL_ITEMS})"
)
SQL_GOLD_KEYS = " union all ".join(
    f"select '{t}' \"name\", count(*) filter (n > 1 and k is not null) repeated_keys, coalesce(sum(n) filter (k is null), 0)::bigint null_keys from (select {k} k, count(*) n from {t} group by 1)" for t, k in star.PRIMARY_KEYS.items()
)
SQL_GOLD_REFERENCES = " union all ".join(
    f"select '{f}.{k}' \"name\", count(distinct {k}) orphan_keys, count(*) orphan_rows from {f} where {k} is not null and {k} not in (select {k} from {d})" for f, k, d in star.FOREIGN_KEYS
)


@REGISTRY.add("gold_primary_keys", f"{SQL_GOLD} {SQL_GOLD_KEYS}")
def gold_primary_keys(spark: SparkSession, folder: str) -> DataFrame:
    return star.primary_keys(gold_tables(spark, folder))


@REGISTRY.add("gold_foreign_keys", f"{SQL_GOLD} {SQL_GOLD_REFERENCES}")
def gold_foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    return star.foreign_keys(gold_tables(spark, folder))


_shown = "'critical' severity"
SQL_GOLD_VALID = " union all ".join(
    [f"select '{t}' \"table\", 'rows' \"check\", count(*) > 0 passed, {_shown}, count(*)::double \"value\", 'at least 1' detail from {t}" for t in star.PRIMARY_KEYS]
    + [f"select 'dim_{n}', 'one current version', count(*) = 0, {_shown}, count(*)::double, '{n}_id' from (select {n}_id from dim_{n} where is_current group by 1 having count(*) > 1)" for n in star.DIMENSIONS]
    + [f"select 'dim_{n}', 'validity columns', count(*) = 3, {_shown}, count(*)::double, '3' from (select unnest(json_keys(to_json(t))) k from (from dim_{n} limit 1) t) where k in ('valid_from_ts', 'valid_to_ts', 'is_current')" for n in star.DIMENSIONS]
    + [f"select \"name\", 'primary key', repeated_keys + null_keys = 0, {_shown}, (repeated_keys + null_keys)::double, 'unique, not null' from ({SQL_GOLD_KEYS})"]
    + [f"select split_part(\"name\", '.', 1), 'foreign key', orphan_rows = 0, {_shown}, orphan_rows::double, split_part(\"name\", '.', 2) from ({SQL_GOLD_REFERENCES})"]
)


@REGISTRY.add("gold_validation", f"{SQL_GOLD} {SQL_GOLD_VALID}")
def gold_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that ``build_gold`` requires of the star before it is served."""
    return star.validate(gold_tables(spark, folder))


@REGISTRY.add(
    "version_invariants",
    f"with {SQL_DIMS} " + " union all ".join(f"select 'dim_{n}' \"name\", count(*) versions, count(distinct {n}_sk) surrogates, count(*) current_versions, 0 keys_with_two_current from d_{n}" for n in star.DIMENSIONS),
)
def all_version_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [version_invariants(dimension(spark, folder, n), f"{n}_id", f"{n}_sk", f"dim_{n}") for n in star.DIMENSIONS])


RAW_KEYS = [("raw_orders", "order_id"), ("raw_order_items", "order_item_id"), ("raw_menu_items", "menu_item_id"), ("raw_restaurants", "restaurant_id"), ("raw_delivery_events", "event_id")]


@REGISTRY.add(
    "primary_key_violations",
    " union all ".join(
        f"select '{t}' \"name\", count(*) filter (n > 1 and k is not null) repeated_keys, coalesce(sum(n) filter (k is null), 0)::bigint null_keys from (select {k} k, count(*) n from {t} group by {k})" for t, k in RAW_KEYS
    ),
)
def all_primary_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    """By raw spelling; ``primary_key_violations_tidy`` compares tidied."""
    return reduce(DataFrame.unionByName, [primary_key_violations(table(spark, folder, t).select(k), k, t) for t, k in RAW_KEYS])


RAW_REFERENCES = [("raw_orders", "restaurant_id", "raw_restaurants", "restaurant_id"), ("raw_orders", "customer_id", "raw_customers", "customer_id"), ("raw_order_items", "order_id", "raw_orders", "order_id"), ("raw_order_items", "menu_item_id", "raw_menu_items", "menu_item_id"), ("raw_menu_items", "restaurant_id", "raw_restaurants", "restaurant_id")]


@REGISTRY.add(
    "foreign_key_violations",
    " union all ".join(
        f"select '{a}.{k}' \"name\", count(*) orphan_keys, coalesce(sum(n), 0)::bigint orphan_rows from (select {sql_tidy(k)} k, count(*) n from {a} where {sql_tidy(k)} is not null group by 1) where k not in (select {sql_tidy(to)} from {b} where {sql_tidy(to)} is not null)"
        for a, k, b, to in RAW_REFERENCES
    ),
)
def all_foreign_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    checks = [
        foreign_key_violations(table(spark, folder, a).select(tidy(k).alias(k)), k, table(spark, folder, b).select(tidy(to).alias(to)), to, f"{a}.{k}") for a, k, b, to in RAW_REFERENCES
    ]
    return reduce(DataFrame.unionByName, checks)


SQL_MERGE = f"""
with once as (select id customer_id, c city, d district, s segment, valid_from_ts from (select *, row_number() over (partition by id, valid_from_ts order by customer_sk desc, c desc nulls last, d desc nulls last, s desc nulls last) rn
  from (select *, {sql_tidy("customer_id")} id, {sql_tidy("city")} c, {sql_tidy("district")} d, {sql_tidy("segment")} s from dim_customer) where id is not null and valid_from_ts is not null) where rn = 1),
held as (select *, lead(valid_from_ts) over (partition by customer_id order by valid_from_ts) valid_to_ts from once),
base as (select * from held where valid_to_ts is null),
snap as (select customer_id, city, district, segment from ({sql_latest("customer")})),
j as (select coalesce(b.customer_id, n.customer_id) customer_id, b.customer_id is not null known, b.valid_from_ts, b.city bc, b.district bd, b.segment bs, n.city nc, n.district nd, n.segment ns,
  n.customer_id is not null and (b.city is distinct from n.city or b.district is distinct from n.district or b.segment is distinct from n.segment) differs from base b full join snap n using (customer_id))
select customer_id, bc city, bd district, bs segment, valid_from_ts, case when differs then timestamp '{AS_OF}' end valid_to_ts, not differs is_current from j where known
union all
select customer_id, nc, nd, ns, timestamp '{AS_OF}', null, true from j where (known and differs) or not known
union all
select customer_id, city, district, segment, valid_from_ts, valid_to_ts, false from held where valid_to_ts is not null"""


@REGISTRY.add("dim_customer_merge", SQL_MERGE)
def dim_customer_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All versions of dim_customer, merged with a snapshot of raw_customers: changed ones closed and opened anew.

    A version ends where the customer's next one begins, as valid_to_ts can't be trusted; the past stays as it is.
    """
    cols = ["city", "district", "segment"]
    rows = table(spark, folder, "dim_customer").select(tidy("customer_id").alias("customer_id"), *[tidy(c).alias(c) for c in cols], "valid_from_ts", "customer_sk")
    known = keep_best(rows.where("customer_id is not null and valid_from_ts is not null"), ["customer_id", "valid_from_ts"], [F.col("customer_sk"), *[F.col(c) for c in cols]])
    ended = with_neighbour(ranged(known.drop("customer_sk"), ["customer_id", "valid_from_ts"], unique=True), ["customer_id"], ["valid_from_ts"], "_next", after=True)
    base = ended.select("customer_id", *cols, "valid_from_ts", F.col("_next.valid_from_ts").alias("valid_to_ts"), F.col("_next").isNull().alias("is_current"))
    return merge_versions(base, latest(spark, folder, "customer").select("customer_id", *cols), "customer_id", cols, as_of())


SQL_REF = "(select max(order_time) from stg)"


@REGISTRY.add(
    "feat_customer_order_freq_7d",
    f"with stg as ({SQL_STG}) select customer_id, count(*) order_freq, {SQL_REF} event_timestamp, timestamp '{AS_OF}' created from stg where order_time >= {SQL_REF} - interval 7 days group by customer_id",
)
def feat_customer_order_freq_7d(spark: SparkSession, folder: str) -> DataFrame:
    return features.order_frequency(stg_orders(spark, folder), 7, as_of())


@REGISTRY.add(
    "feat_restaurant_avg_prep_time_30d",
    f"""with stg as ({SQL_STG}), d as ({sql_latest("restaurant")})
select restaurant_id, round(avg(prep_time_minutes), 2) avg_prep_time, count(*) orders, {SQL_REF} event_timestamp, timestamp '{AS_OF}' created
from stg join d using (restaurant_id) where order_time >= {SQL_REF} - interval 30 days group by restaurant_id""",
)
def feat_restaurant_avg_prep_time_30d(spark: SparkSession, folder: str) -> DataFrame:
    return features.preparation_time(stg_orders(spark, folder), latest(spark, folder, "restaurant"), 30, as_of())


@REGISTRY.add(
    "feat_driver_acceptance_rate_7d",
    f"""with stg as ({SQL_STG}) select driver_id, round(count(*) filter (status = 'completed') / count(*), 4) acceptance_rate, count(*) orders, {SQL_REF} event_timestamp, timestamp '{AS_OF}' created
from stg where order_time >= {SQL_REF} - interval 7 days and driver_id is not null group by driver_id""",
)
def feat_driver_acceptance_rate_7d(spark: SparkSession, folder: str) -> DataFrame:
    return features.acceptance_rate(stg_orders(spark, folder), 7, as_of())
