"""Schemas that drift between the files of a feed: profiles, rename detection by matching, one unified table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import tidy
from tidemill.operators.ordered import place
from tidemill.operators.sized import skew_join
from tidemill.session import cut, written

#: Value sketches hold up to 2**SKETCH_LG hashes; smaller sets are held exactly.
SKETCH_LG = 12
FILE = ["feed_id", "file_no"]
#: The field that names what a record is of.
ITEM = "menu_item_id"


def records(files: DataFrame, key: str = ITEM) -> DataFrame:
    """Readable records as variants: (feed_id, file_no, file_id, line_no, item, v); a record that isn't an object isn't readable.

    ``item`` is the record's value of ``key``, trimmed and in lower case. Rows without a feed or number are left
    out. feed_id is trimmed and in lower case.
    """
    # only an object begins with a brace
    objects = files.where(F.ltrim(F.col("record"), F.lit(" \t\r\n")).startswith("{"))
    parsed = objects.select(tidy("feed_id").alias("feed_id"), F.col("file_no").cast("bigint").alias("file_no"), "file_id", "line_no", F.try_parse_json("record").alias("v"))
    return parsed.where("feed_id is not null and file_no is not null and v is not null").withColumn("item", tidy(F.try_variant_get("v", f"$['{key}']", "string")))


def fields_of(files: DataFrame, key: str = ITEM) -> DataFrame:
    """One row a field of a readable record, parsed once and kept: (feed_id, file_no, file_id, line_no, item, name, kind, val).

    ``kind`` is null for a null value; ``val`` is the value as text; ``item`` is the record's value of ``key``, trimmed
    and in lower case.
    """
    rows = records(files, key)
    long = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    t = F.schema_of_variant("value")
    kind = (
        F.when(t == "VOID", F.lit(None).cast("string"))
        .when(t == "BOOLEAN", "boolean")
        .when(t == "BIGINT", "long")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "double")
        .otherwise("string")
    )
    as_text = F.when(kind == "double", F.try_variant_get("value", "$", "double").cast("string")).otherwise(F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")))
    return written(long.select(*FILE, "file_id", "line_no", "item", F.col("key").alias("name"), kind.alias("kind"), F.when(kind.isNotNull(), as_text).alias("val")), "fields")


#: Kinds as bits, so that those of a field are united by an aggregate of fixed width.
KINDS = {"boolean": 1, "long": 2, "double": 4, "string": 8}


def profiles(fields: DataFrame) -> DataFrame:
    """Per file and field: (feed_id, file_no, name, kind); kind is null if the field is null throughout.

    Long and double together are double, any other mixture is string. Combined before the shuffle.
    """
    bit = F.lit(0)
    for kind, n in KINDS.items():
        bit = F.when(F.col("kind") == kind, n).otherwise(bit)
    rows = fields.groupBy(*FILE, "name").agg(F.bit_or(bit).alias("_kinds"))
    one = F.when(F.col("_kinds") == 0, F.lit(None).cast("string"))
    for kind, n in KINDS.items():
        one = one.when(F.col("_kinds") == n, kind)
    return rows.select(*FILE, "name", one.when(F.col("_kinds") == KINDS["long"] + KINDS["double"], "double").otherwise("string").alias("kind"))


def _similar(a: Column, b: Column) -> Column:
    """Likeness of two names from 0 to 1, regardless of case and underscores."""
    plain = lambda c: F.lower(F.translate(c, "_- ", ""))
    return 1 - F.levenshtein(plain(a), plain(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def best_matching(weights: list[list[float]]) -> list[int]:
    """Column of each row, -1 for none, in a bipartite matching of greatest total weight; weights of 0 are no edges.

    Shortest augmenting paths with potentials, O(n^3) for n fields.
    """
    n = max(len(weights), max((len(r) for r in weights), default=0))
    cost = [[-(weights[i][j] if i < len(weights) and j < len(weights[i]) else 0.0) for j in range(n)] for i in range(n)]
    inf = float("inf")
    up, vp, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], col = i, n
        dist, back, done = [inf] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while owner[col] != n or col == n:
            done[col] = True
            row, step, nxt = owner[col], inf, n
            for j in range(n):
                if not done[j]:
                    reduced = cost[row][j] - up[row] - vp[j]
                    if reduced < dist[j]:
                        dist[j], back[j] = reduced, col
                    if dist[j] < step:
                        step, nxt = dist[j], j
            for j in range(n + 1):
                if done[j]:
                    up[owner[j]] += step
                    vp[j] -= step
                else:
                    dist[j] -= step
            col = nxt
        while col != n:
            owner[col], col = owner[back[col]], back[col]
    out = [-1] * len(weights)
    for j in range(n):
        if owner[j] < len(weights) and j < len(weights[owner[j]]) and weights[owner[j]][j] > 0:
            out[owner[j]] = j
    return out


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matching of one file: fields that no edge links, directly or over others, are matched apart."""
    part: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x: tuple[str, str]) -> tuple[str, str]:
        while part.setdefault(x, x) != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for old, new in zip(pdf["old"], pdf["new"], strict=True):
        part[root(("old", old))] = root(("new", new))
    pairs = []
    for _, some in pdf.groupby([str(root(("old", x))) for x in pdf["old"]]):
        olds, news = sorted(set(some["old"])), sorted(set(some["new"]))
        row, col = {x: i for i, x in enumerate(olds)}, {x: i for i, x in enumerate(news)}
        weights = [[0.0] * len(news) for _ in olds]
        for old, new, w in zip(some["old"], some["new"], some["weight"], strict=True):
            weights[row[old]][col[new]] = w
        pairs += [(olds[i], news[j]) for i, j in enumerate(best_matching(weights)) if j >= 0]
    return pd.DataFrame({"feed_id": pdf["feed_id"].iloc[0], "file_no": pdf["file_no"].iloc[0], "old": [a for a, _ in pairs], "new": [b for _, b in pairs]})


def renames(values: DataFrame) -> DataFrame:
    """(feed_id, file_no, old, new) from ``values`` of vanished (side 'old') and new (side 'new') fields.

    ``values`` has one row per file, side, field and item. Pairs of a vanished and a new field come from the
    value sketches: those whose overlap, with six standard errors in favour, may reach half of the items that
    both hold (sketches of up to 4,096 values are exact). Such pairs are then counted exactly, and a matching
    of greatest weight (share of equal values, then likeness of names) picks the renames among those that agree
    on more than half. The pairs of a file number as its changed fields.
    """
    sketched = values.groupBy(*FILE, "side", "name").agg(
        F.theta_sketch_agg(F.xxhash64("item", "kind", "val"), SKETCH_LG).alias("of_values"), F.theta_sketch_agg("item", SKETCH_LG).alias("of_items"), F.count("*").alias("n")
    )
    side = lambda s: sketched.where(F.col("side") == s).select(*FILE, F.col("name").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("of_values", "of_items", "n")])
    pairs = side("old").join(side("new"), FILE)
    overlap = lambda c: F.theta_sketch_estimate(F.theta_intersection(f"{c}_old", f"{c}_new"))
    slack = 6 * (F.col("n_old") + F.col("n_new")) / F.lit(2.0 ** (SKETCH_LG / 2))
    slack = F.when(F.greatest("n_old", "n_new") < 2**SKETCH_LG, 0.0).otherwise(slack)
    likely = pairs.where(2 * (overlap("of_values") + slack) > overlap("of_items") - slack).select(*FILE, "old", "new")
    likely = cut(likely)
    old = values.where("side = 'old'").select(*FILE, F.col("name").alias("old"), "item", F.col("kind").alias("kind_old"), F.col("val").alias("val_old"))
    new = values.where("side = 'new'").select(*FILE, F.col("name").alias("new"), "item", "kind", "val")
    # a file with a third of all rows is spread by item
    both = skew_join(old, likely, [*FILE, "old"], salt_from=F.xxhash64("item")).join(new, [*FILE, "new", "item"])
    counted = both.groupBy(*FILE, "old", "new").agg(F.count("*").alias("both"), F.count_if((F.col("kind") == F.col("kind_old")) & (F.col("val") == F.col("val_old"))).alias("same"))
    edges = counted.where("2 * same > both").withColumn("weight", F.col("same") / F.col("both") + 1e-3 * _similar(F.col("old"), F.col("new")) + 1e-6)
    ends = edges.withColumns({f"_{s}": F.count("*").over(Window.partitionBy(*FILE, s)) for s in ("old", "new")})
    ends = cut(ends.withColumn("_alone", (F.col("_old") == 1) & (F.col("_new") == 1)))
    # an edge that shares no field with others is in every greatest matching; few files have others
    rest = ends.where(~F.col("_alone")).select(*edges.columns).groupBy(*FILE).applyInPandas(_match, "feed_id string, file_no bigint, old string, new string")
    return ends.where("_alone").select(*FILE, "old", "new").unionByName(rest)


def changes(files: DataFrame, key: str = ITEM, fields: DataFrame | None = None) -> DataFrame:
    """Every change of each file against the feed's previous one: (feed_id, file_no, file_id, field, change, new_field).

    change is added, removed, renamed or type_changed; new_field is empty except for renames. Names are
    case-sensitive; records are told apart by their ``key``. A field null throughout keeps the type known before. A
    feed's first file has no changes, and a file without readable records has no fields. An empty input gives an
    empty result. ``fields`` are those of ``files``, where they are at hand.
    """
    fields = fields_of(files, key) if fields is None else fields
    seen = files.select(tidy("feed_id").alias("feed_id"), F.col("file_no").cast("bigint").alias("file_no"), "file_id").where("feed_id is not null and file_no is not null")
    listed = place(seen.groupBy(*FILE).agg(F.min("file_id").alias("file_id")), ["feed_id"], ["file_no"], unique=True)
    around = listed.neighbour(["file_no"], "_prev").neighbour(["file_no", "file_id"], "_next", after=True).rows
    around = around.select(*FILE, "file_id", F.col("_prev.file_no").alias("prev_no"), F.col("_next.file_no").alias("next_no"), F.col("_next.file_id").alias("next_id"))
    # one row a file and field from here on
    by_field = Window.partitionBy("feed_id", "name").orderBy("file_no")
    profile = profiles(fields).join(around, FILE).withColumn("known", F.last("kind", ignorenulls=True).over(by_field.rowsBetween(Window.unboundedPreceding, 0)))
    held = profile.withColumns({"before_no": F.lag("file_no").over(by_field), "was": F.lag("known").over(by_field), "after_no": F.lead("file_no").over(by_field)})
    event = lambda side, no, fid: F.struct(F.lit(side).alias("side"), no.alias("of_no"), fid.alias("of_id"))
    same = F.col("before_no").eqNullSafe(F.col("prev_no"))
    events = [
        F.when(F.col("prev_no").isNotNull() & ~same, event("new", F.col("file_no"), F.col("file_id"))),
        F.when(F.col("prev_no").isNotNull() & same & (F.col("known") != F.col("was")), event("typed", F.col("file_no"), F.col("file_id"))),
        F.when(F.col("next_no").isNotNull() & ~F.col("after_no").eqNullSafe(F.col("next_no")), event("old", F.col("next_no"), F.col("next_id"))),
    ]
    diff = cut(held.select("feed_id", F.col("file_no").alias("at_no"), "name", F.inline(F.array_compact(F.array(*events)))))
    moved = diff.where("side <> 'typed'")
    # values of a vanished field are in the previous file, those of a new one in this one
    told = fields.where("kind is not null and item is not null").select("feed_id", F.col("file_no").alias("at_no"), "name", "line_no", "item", "kind", "val")
    values = (
        skew_join(told, moved.drop("of_id"), ["feed_id", "at_no", "name"], salt_from=F.xxhash64("item"))
        .groupBy("feed_id", F.col("of_no").alias("file_no"), "side", "name", "item")
        .agg(F.min(F.struct("line_no", "kind", "val")).alias("_first"))
        .select(*FILE, "side", "name", "item", "_first.kind", "_first.val")
    )
    renamed = cut(renames(cut(values)))
    ends = renamed.select(*FILE, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("name"), F.col("new").alias("_to")) for s in ("old", "new")])))
    told_of = diff.withColumnRenamed("of_no", "file_no").join(ends, [*FILE, "side", "name"], "left").where("not (side = 'new' and _to is not null)")
    change = F.when(F.col("side") == "typed", "type_changed").when(F.col("_to").isNotNull(), "renamed").when(F.col("side") == "old", "removed").otherwise("added")
    return told_of.select(*FILE, F.col("of_id").alias("file_id"), F.col("name").alias("field"), change.alias("change"), F.coalesce("_to", F.lit("")).alias("new_field"))


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    roots: dict[str, str] = {}
    out = []
    for _, events in pdf.sort_values("file_no").groupby("file_no"):
        before = dict(roots)
        for field, change, new in zip(events["field"], events["change"], events["new_field"], strict=True):
            name, root = (new, before.get(field, field)) if change == "renamed" else (field, field)
            roots[name] = root
            out.append((pdf["feed_id"].iloc[0], int(events["file_no"].iloc[0]), name, root))
    return pd.DataFrame(out, columns=["feed_id", "from_no", "name", "root"])


def lines_once(files: DataFrame) -> DataFrame:
    """``files`` (feed_id, file_no, file_id, line_no, record) with a record repeated in its file once, at its first line, then least file_id, nulls last."""
    order = F.struct(F.col("line_no").isNull(), "line_no", F.col("file_id").isNull(), "file_id")
    each = files.withColumns({"feed_id": tidy("feed_id"), "_h": F.sha2("record", 256)}).groupBy("feed_id", "file_no", "_h").agg(F.min_by(F.struct("file_id", "line_no", "record"), order).alias("_r"))
    return each.select("feed_id", "file_no", "_r.*")


def unified(files: DataFrame, found: DataFrame, key: str = ITEM, fields: DataFrame | None = None) -> DataFrame:
    """One table of all items: (feed_id, file_no, file_id, line_no, item, fields), a line repeated in its file once.

    ``fields`` maps every unified name to the value as text; ``item`` is the record's ``key``. A field goes by the
    first name of its chain of renames in the feed (``found``, from ``changes``); if a record gives two names of one
    chain, the greatest value stays. The chain of a feed is followed over its renames and additions only. The argument
    ``fields`` is ``fields_of(lines_once(files))``, where it is at hand.
    """
    events = found.where("change in ('renamed', 'added')").select(*FILE, "field", "change", "new_field")
    roots = events.groupBy("feed_id").applyInPandas(_roots, "feed_id string, from_no bigint, name string, root string")
    fields = fields_of(lines_once(files), key) if fields is None else fields
    profile = fields.select(*FILE, "name").distinct()
    mapped = cut(profile.join(roots, ["feed_id", "name"]).where("from_no <= file_no").groupBy(*FILE, "name").agg(F.max_by("root", "from_no").alias("root")).where("root <> name"))
    named = skew_join(fields.drop("kind"), mapped, [*FILE, "name"], "left", salt_from=F.xxhash64("line_no")).withColumn("root", F.coalesce("root", "name"))
    # a record's few fields come together again; its lines are spread by line number
    one = named.groupBy(*FILE, "file_id", "line_no", "item", "root").agg(F.max("val").alias("val"))
    return one.groupBy(*FILE, "file_id", "line_no", "item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("root", "val")))).alias("fields"))
