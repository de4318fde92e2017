"""Full history of changing attributes: insert-only satellites, with end dates in a lead-based view.

A store has two tables, and rows are only ever added to either. ``seen`` has a row for every moment of a key that was
ever read: its digests, one for each satellite, and no attributes. ``satellites`` has the attributes, as a JSON text, of
those moments at which the digest of a satellite differed from that of the moment before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import RANGE_ROWS, Placed, place
from tidemill.operators.sized import skew_join
from tidemill.session import written


@dataclass
class Layout:
    """What a store is of: key, moment, attributes in satellites, and the columns of which the greatest decide at one moment."""

    key: str
    at: str
    groups: list[list[str]]
    priority: list[str]

    @property
    def digests(self) -> list[str]:
        return [f"_d{i}" for i in range(len(self.groups))]


def hash_diff(cols: list[str], of: str = "") -> Column:
    """A digest (16 bytes) of attributes, those of the row or of its struct ``of``; null differs from every text, and texts can't run into each other."""
    return F.unhex(F.md5(_payload(cols, of).cast("binary")))


def _payload(cols: list[str], of: str = "") -> Column:
    return F.to_json(F.struct(*[F.col(f"{of}.{c}" if of else c).alias(c) for c in cols]), {"ignoreNullFields": "false"})


def moments(readings: DataFrame, key: str, at: str, cols: list[str], priority: list[str]) -> DataFrame:
    """One state per key and moment, (key, at, cols, priority): that of the reading with the highest ``priority``, nulls lowest.

    Readings without a key or a moment are left out. The best one is chosen by an aggregate that combines
    before the shuffle, so many readings of one moment are no burden; ties go to the greatest attributes.
    """
    best = F.max(F.struct(*priority, *cols))
    return readings.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(best.alias("_state")).select(key, at, *[F.col(f"_state.{c}").alias(c) for c in [*cols, *priority]])


def paired(readings: DataFrame, key: str, at: str, cols: list[str], priority: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The moments, each with struct ``_before`` of the attributes at its key's moment before, kept in the shared folder.

    Readings of a key are counted first. Unless one has more than ``range_rows``, rows are brought together by key
    once, for the moments and for their order alike; else moments are made by (key, moment) and ordered over ranges.
    """
    known = readings.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, *cols, *priority)
    most = known.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= range_rows:
        placed = Placed(moments(known.repartition(key), key, at, cols, priority), [key], [at], False)
    else:
        placed = place(moments(known, key, at, cols, priority), [key], [at], range_rows, unique=True)
    return written(placed.neighbour(cols, "_before").plain(), "moments")


def change_counts(pairs: DataFrame, cols: list[str]) -> dict[str, int]:
    """How often each attribute changes from a key's moment to the next: one number an attribute."""
    row = pairs.where("_before is not null").agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_before.{c}"))).alias(c) for c in cols]).first()
    return {c: row[c] or 0 for c in cols}


def split_by_rate(counts: dict[str, int], ratio: float = 2.0) -> list[list[str]]:
    """Attributes in groups of like change rate: a new group where the rate is over ``ratio`` times the one below."""
    groups: list[list[str]] = []
    last = None
    for c in sorted(counts, key=lambda c: (counts[c], c)):
        if last is None or counts[c] + 1 > ratio * (last + 1):
            groups.append([])
        groups[-1].append(c)
        last = counts[c]
    return groups


def _long(rows: DataFrame, layout: Layout, attributes: bool) -> DataFrame:
    """(key, at, priority, satellite, hash_diff, is_new, attributes) of rows with digests and ``_before``, those of the moment before."""
    first = F.col("_before").isNull()
    each = [
        F.struct(F.lit(i).alias("satellite"), F.col(d).alias("hash_diff"), (first | (F.col(d) != F.col(f"_before.{d}"))).alias("is_new"), (_payload(g) if attributes else F.col(f"_a{i}")).alias("attributes"))
        for i, (d, g) in enumerate(zip(layout.digests, layout.groups, strict=True))
    ]
    return rows.select(layout.key, layout.at, *layout.priority, F.inline(F.array(*each)))


def first_load(pairs: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(seen, satellites) of an empty store, from ``paired`` moments."""
    own = pairs.withColumns({d: hash_diff(g) for d, g in zip(layout.digests, layout.groups, strict=True)})
    seen = own.select(layout.key, layout.at, *layout.priority, *layout.digests)
    before = F.struct(*[hash_diff(g, "_before").alias(d) for d, g in zip(layout.digests, layout.groups, strict=True)])
    compared = own.withColumn("_before", F.when(F.col("_before").isNotNull(), before))
    return seen, _long(compared, layout, True).where("is_new").drop("is_new")


def append(seen: DataFrame, satellites: DataFrame, readings: DataFrame, layout: Layout, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows that a load adds to (seen, satellites), stored tables of ``layout``; nothing stored is changed.

    Only keys that the load has readings of are looked at. Readings may be older than what is stored: a moment
    that comes to differ from its new predecessor gets its satellite row now (its attributes are those stored under
    its digest), and one that no longer differs stays, to be passed over by ``view``. At one moment the higher
    priority wins, and of equal priority the later load.
    """
    key, at, cols = layout.key, layout.at, [c for g in layout.groups for c in g]
    fresh = moments(readings, key, at, cols, layout.priority).select(
        key, at, *layout.priority, *[hash_diff(g).alias(d) for d, g in zip(layout.digests, layout.groups, strict=True)], *[_payload(g).alias(f"_a{i}") for i, g in enumerate(layout.groups)], F.lit(1).alias("_load")
    )
    keys = fresh.select(key).distinct()
    known = skew_join(seen, keys, [key], "left_semi").withColumns({**{f"_a{i}": F.lit(None).cast("string") for i in range(len(layout.groups))}, "_load": F.lit(0)})
    carried = [*layout.digests, *[f"_a{i}" for i in range(len(layout.groups))], "_load"]
    best = fresh.unionByName(known.select(*fresh.columns)).groupBy(key, at).agg(F.max(F.struct(*layout.priority, "_load", *[c for c in carried if c != "_load"])).alias("_best"))
    states = best.select(key, at, *[F.col(f"_best.{c}").alias(c) for c in [*layout.priority, *carried]])
    placed = place(states, [key], [at], range_rows, unique=True)
    new_seen = placed.plain().where("_load = 1").select(*seen.columns)
    wanted = _long(placed.neighbour(layout.digests, "_before").rows, layout, False)
    stored = skew_join(satellites, keys, [key], "left_semi")
    held = _current(stored, layout).select(key, at, "satellite", F.col("hash_diff").alias("_held"))
    missing = wanted.join(held, [key, at, "satellite"], "left").where("(_held is null and is_new) or _held <> hash_diff").drop("_held", "is_new")
    # a moment read before has its attributes in the store, under the same digest
    texts = stored.groupBy(key, "satellite", "hash_diff").agg(F.min("attributes").alias("_stored"))
    old, new = missing.where("attributes is null").drop("attributes"), missing.where("attributes is not null")
    return new_seen, new.unionByName(skew_join(old, texts, [key, "satellite", "hash_diff"]).withColumnRenamed("_stored", "attributes").select(*new.columns)).select(*satellites.columns)


def _current(satellites: DataFrame, layout: Layout) -> DataFrame:
    """Of each key, moment and satellite the row that counts: the highest priority."""
    best = F.max(F.struct(*layout.priority, "hash_diff", "attributes"))
    return satellites.groupBy(layout.key, layout.at, "satellite").agg(best.alias("_b")).select(layout.key, layout.at, "satellite", "_b.hash_diff", "_b.attributes")


def view(satellites: DataFrame, layout: Layout, types: dict[str, str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The lead-based view: (key, attributes, valid_from, valid_to, is_current, changed); valid_to is null for the last version.

    A version begins where the digest of some satellite differs from what it was, and ends where the key's next
    one begins. Attributes come from the satellites' texts, each carried on until its satellite's next row;
    ``types`` names theirs. ``changed`` lists the satellites that begin the version.
    """
    key, at = layout.key, layout.at
    n = len(layout.groups)
    picked = [F.max(F.when(F.col("satellite") == i, F.struct(*layout.priority, "hash_diff", "attributes"))).alias(f"_b{i}") for i in range(n)]
    wide = satellites.groupBy(key, at).agg(*picked).select(key, at, *[F.col(f"_b{i}.hash_diff").alias(f"_d{i}") for i in range(n)], *[F.col(f"_b{i}.attributes").alias(f"_a{i}") for i in range(n)])
    whole = place(wide, [key], [at], range_rows, unique=True).carried([*layout.digests, *[f"_a{i}" for i in range(n)]]).neighbour(layout.digests, "_before")
    fresh = [F.col("_before").isNull() | ~F.col(d).eqNullSafe(F.col(f"_before.{d}")) for d in layout.digests]
    began = whole.where(reduce(lambda a, b: a | b, fresh)).neighbour([at], "_next", after=True)
    parsed = [F.from_json(f"_a{i}", ", ".join(f"`{c}` {types[c]}" for c in g)).alias(f"_p{i}") for i, g in enumerate(layout.groups)]
    out = began.rows.select(
        key, F.col(at).alias("valid_from"), F.col(f"_next.{at}").alias("valid_to"), F.col("_next").isNull().alias("is_current"),
        F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fresh)])).alias("changed"), *parsed,
    )
    return out.select(key, *[F.col(f"_p{i}.{c}").alias(c) for i, g in enumerate(layout.groups) for c in g], "valid_from", "valid_to", "is_current", "changed")
