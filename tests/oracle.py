"""Run registered queries and their SQL side by side and compare whole results.

    python tests/oracle.py [--sf DIR] [--chunk N] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date",
}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


def _rows(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def compare(spark, con, sf: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    types = dict(df.dtypes)
    cur = con.execute(f"SELECT {', '.join(names)} FROM ({sql})")
    want_types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cur.description}
    want = _rows(cur.fetchall())
    all_cols = {d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    if all_cols != set(names):
        return f"columns {names} vs {sorted(all_cols)}"
    got = _rows(tuple(r) for r in df.select(*names).collect())
    bad = {n: (types[n], want_types[n]) for n in names if types[n] != want_types[n]}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(diff)} of {len(got)} rows differ, e.g. {names} {diff[:2]}"
    if bad:
        return f"types {bad}"
    if not got:
        return "empty"
    return None


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--chunk", type=int)
    p.add_argument("prefix", nargs="*")
    a = p.parse_args()
    import __spark_entry__ as entry
    from cutline.session import session

    spark = session(
        "cutline-oracle", master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="10g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if a.chunk:
        spark.conf.set("spark.cutline.rowsPerChunk", str(a.chunk))
    con, sqls, failed = connect(a.sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if a.prefix and not any(name.startswith(x) for x in a.prefix):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, a.sf, fn, sqls[name])
                note = "ok" if msg is None else "DIFF " + msg
            else:
                note = f"rows-only {fn(spark, a.sf).count()}"
                msg = None
        except Exception as e:  # noqa: BLE001 - report every query
            msg = note = "ERROR " + str(e)[:1500]
        if msg:
            failed.append(name)
        print(f"{name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
