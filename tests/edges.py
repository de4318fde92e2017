"""Folders of awkward tables: empty ones, and ones with nulls everywhere, repeated rows and foreign columns."""

from __future__ import annotations

import pathlib

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = pathlib.Path("/root/testdata/sf0.001")
CLASHES = ["rank", "key", "value", "rows", "_id", "_shard", "_state", "_v", "_lo", "_range", "_place", "_salt", "at", "raw", "sk", "window_us", "batch", "tokens", "visible", "v", "side", "item", "kind", "bits", "word", "mask", "bucket", "rate", "start"]


def empty(folder: pathlib.Path) -> str:
    for p in SOURCE.glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), folder / p.name)
    return str(folder)


def awkward(folder: pathlib.Path) -> str:
    """Half of the rows, some twice, a row of nulls only, one row for each column without it, and columns that clash."""
    for p in SOURCE.glob("*.parquet"):
        t = pq.read_table(p)
        some = t.slice(0, max(20, t.num_rows // 2))
        rows = some.slice(0, 1).to_pylist()
        holes, again = [{c: None for c in t.column_names}] * 2, 0
        if p.stem not in ("common_words", "mix_targets", "pack_capacities"):
            # an identifier that is given as unique (doc_id) keeps its value
            holes, again = holes + [{**rows[0], c: None} for c in t.column_names if c != "doc_id"], 15
        if "_kafka_offset" in t.column_names:
            # partition and offset are unique together, so no two different messages tie
            holes = [h if h["_kafka_offset"] is None else {**h, "_kafka_offset": 10**9 + i} for i, h in enumerate(holes)]
        more = pa.Table.from_pylist(holes, t.schema)
        out = pa.concat_tables([some, some.slice(0, again), more])
        for c in CLASHES:
            if c not in out.column_names:
                out = out.append_column(c, pa.array([None if i % 3 else f"x{i}" for i in range(out.num_rows)]))
        pq.write_table(out, folder / p.name)
    return str(folder)
