"""Problem 4: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy_upper
from tidemill.operators.drift import changes, fields_of, lines_once, unified
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.session import cut, written
from tidemill.sources.tables import table

REGISTRY = Registry()

SQL_FOUND = f"""
with rec as (
  select {sql_tidy("feed_id")} feed_id, file_no, file_id, line_no, case when json_valid(record) then case when json_type(record) = 'OBJECT' then record end end::json r
  from menu_file_records where {sql_tidy("feed_id")} is not null and file_no is not null
), f as (
  select feed_id, file_no, min(file_id) file_id, lag(file_no) over w prev_no from rec group by feed_id, file_no window w as (partition by feed_id order by file_no)
), v as (
  select rec.feed_id, rec.file_no, line_no, {sql_tidy("r->>'$.menu_item_id'")} item, e.key "name", e.type t, e.value val,
    case e.type when 'NULL' then null when 'BOOLEAN' then 'boolean' when 'BIGINT' then 'long' when 'UBIGINT' then 'long' when 'DOUBLE' then 'double' else 'string' end kind
  from rec, json_each(rec.r) e where r is not null
), p as (
  select feed_id, file_no, "name", case when count(distinct kind) = 0 then null when count(distinct kind) = 1 then min(kind)
    when count(distinct kind) = 2 and min(kind) = 'double' and max(kind) = 'long' then 'double' else 'string' end kind from v group by all
), k as (
  select *, last_value(kind ignore nulls) over (partition by feed_id, "name" order by file_no) known from p
), n as (select k.*, f.file_id from k join f using (feed_id, file_no) where prev_no is not null
), o as (select k.feed_id, f.file_no, k."name", k.known, f.file_id, f.prev_no from k join f on f.feed_id = k.feed_id and f.prev_no = k.file_no
), gone as (select * from o anti join n using (feed_id, file_no, "name")
), came as (select * from n anti join o using (feed_id, file_no, "name")
), x as (select feed_id, file_no, "name", item, min(kind) kind, min(case when kind = 'double' then (val::double)::varchar else val::varchar end) val from v where kind is not null and item is not null group by all
), e as (
  select gone.feed_id, gone.file_no, gone.file_id, gone."name" old, came."name" new, count(*) both_, count(*) filter (a.kind = b.kind and a.val = b.val) same
  from gone join came using (feed_id, file_no) join x a on a.feed_id = gone.feed_id and a.file_no = gone.prev_no and a."name" = gone."name"
  join x b on b.feed_id = came.feed_id and b.file_no = came.file_no and b."name" = came."name" and b.item = a.item group by all having 2 * same > both_
)
select file_id, "name" field, 'added' change, '' new_field from came where not exists (select 1 from e where e.feed_id = came.feed_id and e.file_no = came.file_no and e.new = came."name")
union all
select file_id, "name", 'removed', '' from gone where not exists (select 1 from e where e.feed_id = gone.feed_id and e.file_no = gone.file_no and e.old = gone."name")
union all
select file_id, old, 'renamed', new from e
union all
select n.file_id, "name", 'type_changed', '' from n join o using (feed_id, file_no, "name") where n.known <> o.known"""


@REGISTRY.add("p4_found", SQL_FOUND)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes(table(spark, folder, "menu_file_records")).select("file_id", "field", "change", "new_field")


SQL_UNIFIED = (
    SQL_FOUND.replace("with rec as (", "with recursive rec as (", 1).split("\nselect file_id, \"name\" field, 'added'")[0]
    + f""", came_only as (select * from came where not exists (select 1 from e where e.feed_id = came.feed_id and e.file_no = came.file_no and e.new = came."name")
), ev as (select feed_id, file_no, new "name", old prior from e union all select feed_id, file_no, "name", null from came_only
), walk(feed_id, file_no, "name", cur, upto) as (
  select feed_id, file_no, "name", "name", file_no + 1 from p
  union all
  select w.feed_id, w.file_no, w."name", x.prior, x.file_no from walk w, lateral (select prior, ev.file_no from ev where ev.feed_id = w.feed_id and ev."name" = w.cur and ev.file_no < w.upto order by ev.file_no desc limit 1) x where x.prior is not null
), roots as (select feed_id, file_no, "name", arg_min(cur, upto) root from walk group by all
), l as (select * from (select *, row_number() over (partition by feed_id, file_no, r::varchar order by line_no nulls last, file_id nulls last) rn from rec where r is not null) where rn = 1
), x2 as (select feed_id, file_no, file_id, line_no, {sql_tidy("l.r->>'$.menu_item_id'")} item, j.key "name", case j.type when 'NULL' then null when 'DOUBLE' then (j.value::double)::varchar else j.value ->> '$' end val from l, json_each(l.r) j
), u as (select feed_id, file_no, file_id, line_no, item, root, max(val) val from x2 join roots using (feed_id, file_no, "name") group by all
), m as (select file_id, line_no, item, map_from_entries(list((root, val) order by root)) f from u group by feed_id, file_no, file_id, line_no, item)
select file_id, line_no, upper(item) menu_item_id, upper({sql_tidy("f['restaurant_id']")}) restaurant_id, f['name'] "name", f['category'] category, try_cast(f['price'] as double) price,
  case when lower(f['is_available']) in ('true', 'yes', '1', '1.0') then true when lower(f['is_available']) in ('false', 'no', '0', '0.0') then false end is_available,
  try_cast(f['spice_level'] as double) spice_level, array_to_string(list_sort(map_keys(f)), ',') all_names, len(list_filter(map_values(f), lambda x: x is not null)) given from m"""
)


@REGISTRY.add("p4_unified_items", SQL_UNIFIED)
def p4_unified_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items under one schema, with the unified names that their record has, and how many of them with a value.

    Values that don't fit the type of their column are null here; ``unified`` has all of them as text.
    """
    files = written(lines_once(table(spark, folder, "menu_file_records")), "lines")
    fields = fields_of(files)
    f = lambda c: F.col("fields")[c]
    yes, no = ["true", "yes", "1", "1.0"], ["false", "no", "0", "0.0"]
    return unified(files, cut(changes(files, fields=fields)), fields=fields).select(
        "file_id",
        "line_no",
        F.upper("item").alias("menu_item_id"),
        tidy_upper(f("restaurant_id")).alias("restaurant_id"),
        f("name").alias("name"),
        f("category").alias("category"),
        f("price").try_cast("double").alias("price"),
        F.when(F.lower(f("is_available")).isin(yes), True).when(F.lower(f("is_available")).isin(no), False).alias("is_available"),
        f("spice_level").try_cast("double").alias("spice_level"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("all_names"),
        F.size(F.filter(F.map_values("fields"), lambda x: x.isNotNull())).alias("given"),
    )
