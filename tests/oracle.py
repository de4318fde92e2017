"""Run queries beside their SQL twins: python -m tests.oracle [--sf DIR] [NAME...]. Prints one line a query."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb


def frame(rows: list[tuple], cols: list[str]) -> list[tuple]:
    by = sorted(range(len(cols)), key=lambda k: cols[k])

    def plain(x):
        if isinstance(x, float):
            return float(f"{x:.9g}")
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if type(x).__name__ == "Decimal":
            return float(x)
        return x

    return sorted((tuple(plain(r[k]) for k in by) for r in rows), key=repr)


def compare(spark, folder: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    con = duckdb.connect()
    import glob
    import os

    for f in glob.glob(f"{folder}/*.parquet"):
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{at}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = frame(got, df.columns), frame(want, cols)
    if a == b:
        return True, f"{len(a)} rows equal, {took:.1f} s"
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return False, f"{len(a)} rows against {len(b)}; only Spark {sorted(sa - sb)[:3]}; only SQL {sorted(sb - sa)[:3]}"


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    import __spark_entry__ as entry

    from tidemill.session import build_session

    spark = build_session("verify", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/tidemill-verify-warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name in [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]:
        try:
            ok, said = compare(spark, folder, name, queries[name], sqls.get(name))
        except Exception:
            ok, said = False, traceback.format_exc()[-1500:]
        bad += not ok
        print("ok  " if ok else "FAIL", name, said, flush=True)
    spark.stop()
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
