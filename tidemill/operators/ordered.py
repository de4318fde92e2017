"""Neighbours and ranks in a total order, without one task a key."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.session import cut, parallelism

#: Rows that one range is sized for.
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, order: list[Column | str], range_rows: int = RANGE_ROWS, rows: int | None = None, unique: bool = False) -> DataFrame:
    """``df`` sorted by ``order`` in ranges of even size, kept in the shared folder, with its place.

    Rows that tie in all of ``order`` are told apart by a hash of what they hold and then by where they are read,
    so copies of one row are spread over ranges too; ``unique`` says that no rows tie, which saves that.

    ``_range`` numbers the ranges in order and ``_place`` the rows: both rise along the order. The ranges are cut
    by the whole order, so a key with a third of all rows covers a third of them. Since ranges are drawn
    from a sample, the result is kept, not made anew by each reader. ``rows`` is a bound of the number of rows
    that is cheaper to have than their count.
    """
    rows = df.count() if rows is None else rows
    ranges = max(parallelism(df.sparkSession), -(-rows // range_rows))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if not unique:
        plain = [c for c, t in df.dtypes if not any(x in t for x in ("map<", "variant"))]
        df = df.withColumns({"_like": F.xxhash64(*plain), "_read": F.monotonically_increasing_id()})
        cols += [F.col("_like"), F.col("_read")]
    placed = df.repartitionByRange(ranges, *cols).sortWithinPartitions(*cols).drop("_like", "_read").withColumn("_place", F.monotonically_increasing_id())
    return cut(placed.withColumn("_range", F.shiftright("_place", 33).cast("int")))


def with_neighbour(placed: DataFrame, keys: list[str], cols: list[str], name: str, after: bool = False) -> DataFrame:
    """Add struct ``name`` of ``cols`` of the row before (or after) within the same ``keys``, null at the ends.

    ``placed`` comes from ``ranged`` over (keys, ...). Within a range this is a window over that range; the one
    row that adjoins each other range is joined in, and there are as many of these as ranges.
    """
    step = F.lead if after else F.lag
    here = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c) for c in cols])
    edge = (F.min_by if after else F.max_by)(here, "_place")
    edges = placed.groupBy("_range").agg(edge.alias("_edge"))
    # one row a range: its edge goes to the next range that holds rows
    passed = edges.select("_range", step("_edge").over(Window.orderBy("_range")).alias("_passed"))
    within = placed.withColumn("_near", step(here).over(Window.partitionBy("_range").orderBy("_place")))
    near = F.coalesce("_near", "_passed")
    same = None
    for i, c in enumerate(keys):
        one = near[f"k{i}"].eqNullSafe(F.col(c))
        same = one if same is None else same & one
    if same is not None:
        near = F.when(same, near)
    picked = F.when(near.isNotNull(), F.struct(*[near[c].alias(c) for c in cols]))
    return within.join(F.broadcast(passed), "_range", "left").withColumn(name, picked).drop("_near", "_passed")


def with_rank(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add bigint ``name``: the row's rank, from 0, within its ``keys`` (not null), in the order of ``ranged``.

    Rows of a key before this range are counted per range (one row a key and range), summed, and added to
    the rank within the range. Without keys, ranks run over all rows. A range holds few keys at its edges in common with others, so the counts
    number as ranges and keys together.
    """
    if not keys:
        counts = placed.groupBy("_range").agg(F.count("*").alias("_c"), F.min("_place").alias("_first"))
        before = F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        # one row a range
        offsets = F.broadcast(counts.select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
        return placed.join(offsets, "_range").withColumn(name, F.col("_place") + F.col("_shift")).drop("_shift")
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.min("_place").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(offsets, [*keys, "_range"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_shift")


@dataclass
class Placed:
    """Rows in ``order`` within ``keys``: as windows by key, or over ranges where one key holds more than a range."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    over_ranges: bool

    def where(self, condition: Column | str) -> Placed:
        return replace(self, rows=self.rows.where(condition))

    def select(self, *cols: Column | str) -> Placed:
        """Other columns; keys and order must be among them."""
        return replace(self, rows=self.rows.select(*cols, *(["_range", "_place"] if self.over_ranges else [])))

    def neighbour(self, cols: list[str], name: str, after: bool = False) -> Placed:
        """Add struct ``name`` of ``cols`` of the row before (or after) within the same keys, null at the ends."""
        if self.over_ranges:
            return replace(self, rows=with_neighbour(self.rows, self.keys, cols, name, after))
        step = F.lead if after else F.lag
        return replace(self, rows=self.rows.withColumn(name, step(F.struct(*cols)).over(Window.partitionBy(*self.keys).orderBy(*self.order))))

    def carried(self, cols: list[str]) -> Placed:
        """Each of ``cols`` null no more: the last value before that wasn't null, within the same keys."""
        if self.over_ranges:
            return replace(self, rows=with_carried(self.rows, self.keys, cols))
        upto = Window.partitionBy(*self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        return replace(self, rows=self.rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in cols}))

    def plain(self) -> DataFrame:
        return self.rows.drop("_range", "_place")


def place(df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS, unique: bool = False) -> Placed:
    """Keep ``df`` in the shared folder and place its rows: over ranges if some key is counted to hold more than ``range_rows``."""
    kept = cut(df)
    most = kept.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= range_rows:
        return Placed(kept, keys, order, False)
    return Placed(ranged(kept, [*keys, *order], range_rows, unique=unique), keys, order, True)


def with_carried(placed: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``placed``, from ``ranged`` over (keys, ...), with nulls in ``cols`` filled by the last value before within the same keys.

    What a range hands on is one row: the values carried so far of the key it ends with.
    """
    own = Window.partitionBy("_range", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in cols})
    edge = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    ends = filled.groupBy("_range").agg(F.max_by(edge, "_place").alias("_end")).select("_range", "_end.*")
    mine = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sofar = ends.withColumns({f"v{i}": F.last(f"v{i}", ignorenulls=True).over(mine) for i in range(len(cols))})
    passed = sofar.select("_range", F.lag(F.struct(*[c for c in sofar.columns if c != "_range"])).over(Window.orderBy("_range")).alias("_passed"))
    same = reduce(lambda a, b: a & b, [F.col(f"_passed.k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(keys)])
    # one row a range
    out = filled.join(F.broadcast(passed), "_range", "left")
    return out.withColumns({c: F.coalesce(c, F.when(same, F.col(f"_passed.v{i}"))) for i, c in enumerate(cols)}).drop("_passed")
