"""Exactly one copy of each message: exact quotient hash tables over permuted identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.session import parallelism

#: Identifiers that one shard's table is sized for, and rows that one local table takes at most.
SHARD_ROWS = 1_000_000
LOCAL_ROWS = 500_000
#: Bytes of carried columns after which a local table is closed, however few rows it holds.
LOCAL_BYTES = 64 << 20
#: Leading bits of the permuted identifier that name the shard; the table's slots come from the bits after them.
SHARD_BITS = 24
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CANDIDATE, DROPPED, KEPT = 0, 1, 2
LAST = np.iinfo(np.int64).max


def _half(hexes: Column) -> Column:
    return F.conv(hexes, 16, -10).cast("bigint")


def _mix(c: Column, k: int) -> Column:
    return F.xxhash64(c, F.lit(k))


def permuted(identifier: Column) -> tuple[Column, Column, Column]:
    """An identifier as (upper, lower, wide): 128 bits, permuted, so that any bits of them make an even quotient.

    A UUID is its own 128 bits. Any other text takes those of its MD5 and is kept as a whole in ``wide``, so
    nothing is lost and no two identifiers share all three. The permutation is a Feistel network of four
    rounds, which is one-to-one whatever its round function.
    """
    uuid = identifier.rlike(UUID)
    digits = F.when(uuid, F.translate(identifier, "-", "")).otherwise(F.md5(identifier.cast("binary")))
    upper, lower = _half(F.substring(digits, 1, 16)), _half(F.substring(digits, 17, 16))
    for k in range(2):
        lower = lower.bitwiseXOR(_mix(upper, 2 * k))
        upper = upper.bitwiseXOR(_mix(lower, 2 * k + 1))
    return upper, lower, F.when(~uuid, identifier)


class QuotientTable:
    """Open-addressing table: the quotient (some leading bits) is the slot, the complete remainder is stored.

    ``insert`` takes whole arrays and returns the entry of each row; equal rows get one entry. Since every bit
    that is not implied by the shard is stored and compared, there are no false matches.
    """

    def __init__(self, skip_bits: int = 0) -> None:
        self.skip = np.uint64(skip_bits)
        self.size = 0
        self.keys = np.empty((0, 3), np.int64)
        self._reslot(1024)

    def _home(self, upper: np.ndarray) -> np.ndarray:
        return ((upper.view(np.uint64) << self.skip) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _reslot(self, slots: int) -> None:
        self.bits = max(10, int(slots - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        entries = np.arange(self.size)
        at, mask = self._home(np.ascontiguousarray(self.keys[: self.size, 0])), (1 << self.bits) - 1
        while entries.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & mask

    def insert(self, keys: np.ndarray) -> np.ndarray:
        n = len(keys)
        if self.size + n > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.size], np.empty((max(n, self.size), 3), np.int64)])
        if 2 * (self.size + n) > len(self.slots):
            self._reslot(4 * (self.size + n))
        out, todo, mask = np.empty(n, np.int64), np.arange(n), (1 << self.bits) - 1
        at = self._home(np.ascontiguousarray(keys[:, 0]))
        while todo.size:
            held = self.slots[at]
            free = np.flatnonzero(held < 0)
            if free.size:
                self.slots[at[free]] = -2 - todo[free]  # the last writer of each slot claims it
                won = free[self.slots[at[free]] == -2 - todo[free]]
                ids = np.arange(self.size, self.size + won.size)
                self.keys[ids] = keys[todo[won]]
                self.slots[at[won]] = ids
                self.size += won.size
                held = self.slots[at]
            same = (self.keys[held] == keys[todo]).all(axis=1)
            out[todo[same]] = held[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        return out


def _keys(table: pa.Table, wide: dict[str, int]) -> np.ndarray:
    """Rows of (upper, lower, code), where the code stands for the whole text of an identifier that isn't a UUID."""
    code = np.zeros(table.num_rows, np.int64)
    column = table["_wide"]
    if column.null_count < table.num_rows:
        code = np.array([0 if x is None else wide.setdefault(x, len(wide) + 1) for x in column.to_pylist()], np.int64)
    return np.stack([table["_upper"].to_numpy(), table["_lower"].to_numpy(), code], axis=1)


def _losers(table: pa.Table, order: list[str], skip_bits: int) -> np.ndarray:
    """Which rows have a better copy in ``table``: an earlier one by ``order``, nulls last."""
    seen = QuotientTable(skip_bits)
    entry = seen.insert(_keys(table, {}))
    twice = np.flatnonzero(np.bincount(entry, minlength=seen.size)[entry] > 1)
    lost = np.zeros(table.num_rows, bool)
    if twice.size:
        some = table.take(pa.array(twice))
        ranks = [some[c].to_numpy() if some[c].null_count == 0 else some[c].fill_null(LAST).to_numpy() for c in reversed(order)]
        by = np.lexsort([*ranks, entry[twice]])
        first = np.ones(by.size, bool)
        first[1:] = entry[twice][by][1:] != entry[twice][by][:-1]
        lost[twice[by[~first]]] = True
    return lost


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= LOCAL_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _set(table: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    k = table.schema.get_field_index(name)
    return table.set_column(k, table.schema.field(k), pa.array(values, table.schema.field(k).type))


def _local(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, LOCAL_ROWS):
            state = table["_state"].to_numpy().copy()
            mine = np.flatnonzero(state == CANDIDATE)
            if mine.size:
                lost = mine[_losers(table.take(pa.array(mine)), order, 0)]
                state[lost] = DROPPED
                shard = table["_shard"].to_numpy().copy()
                shard[lost] = table["_spread"].to_numpy()[lost]
                table = _set(_set(table, "_state", state), "_shard", shard)
            yield from table.to_batches(65536)

    return run


def _final(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            open_ = batch["_state"].to_numpy() == CANDIDATE
            if not open_.all():
                yield batch.filter(pa.array(~open_))
            if open_.any():
                held.append(batch.filter(pa.array(open_)))
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            state = np.where(_losers(table, order, SHARD_BITS), DROPPED, KEPT).astype(np.int32)
            yield from _set(table, "_state", state).to_batches(65536)

    return run


def quotient_dedup(df: DataFrame, identifier: str, order: dict[str, Column], carry: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Mark the one copy of each identifier to keep: ``carry`` columns plus boolean ``is_kept``.

    ``order`` gives bigint columns, by name; of the copies of an identifier the first by them is kept, nulls last;
    if all of them tie, the one with
    the least hash of ``carry`` (columns with the operator's own names raise). Identifiers are compared trimmed and regardless of case. Rows without an
    identifier are all kept; an empty input gives an empty result.

    First every task inserts its own rows into a local table, at most ``LOCAL_ROWS`` at a time, and settles the
    copies it sees; only one row an identifier and table goes on, so an identifier with a third of all rows
    costs its shard no more than a row for every such table. The survivors go to the shard that the leading
    bits of the permuted identifier name (shards are sized by the number of rows), where the rest is settled
    by a table that stores every remaining bit. Rows settled already travel to evenly spread shards. A shard
    holds what it carries of its rows until it is settled: carry keys, and join wide columns to them, or
    lower ``shard_rows``.
    """
    # copies that tie in all of the order are told apart by what they carry, so that a task run again keeps the same
    order = {**order, "_tie": F.xxhash64(*carry)}
    own = ["_id", "_upper", "_lower", "_wide", "_state", "_spread", "_shard", *[f"_o_{name}" for name in order]]
    if clash := {c.lower() for c in carry} & {c.lower() for c in [*own, "is_kept"]}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    shards = max(parallelism(df.sparkSession), -(-df.count() // shard_rows))
    upper, lower, wide = permuted(F.col("_id"))
    zero = F.lit(0).cast("bigint")
    shaped = (
        df.select(*carry, tidy(identifier).alias("_id"), *[c.cast("bigint").alias(f"_o_{name}") for name, c in order.items()])
        .select(
            *carry,
            *[f"_o_{name}" for name in order],
            F.coalesce(upper, zero).alias("_upper"),
            F.coalesce(lower, zero).alias("_lower"),
            wide.alias("_wide"),
            F.when(F.col("_id").isNull(), KEPT).otherwise(CANDIDATE).cast("int").alias("_state"),
            F.pmod(F.xxhash64(*carry), F.lit(1 << SHARD_BITS)).cast("int").alias("_spread"),
        )
        .withColumn("_shard", F.when(F.col("_state") == KEPT, F.col("_spread")).otherwise(F.shiftrightunsigned("_upper", 64 - SHARD_BITS).cast("int")))
    )
    names = [f"_o_{name}" for name in order]
    local = shaped.mapInArrow(_local(names), shaped.schema)
    final = local.repartition(shards, "_shard").mapInArrow(_final(names), shaped.schema)
    return final.select(*carry, (F.col("_state") == KEPT).alias("is_kept"))
