"""Run registered queries in Spark and their SQL in DuckDB and compare.

    python tools/check_oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(_cell(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=lambda r: tuple((x is None, str(type(x)), x) for x in r if True))


def compare(got, want) -> str:
    """Empty when equal, else what differs."""
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}"
    return ""


def run(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    got = table_rows(df.columns, rows)
    if sql is None:
        return took, len(rows), "no SQL"
    cur = con.execute(sql)
    want = table_rows([d[0] for d in cur.description], cur.fetchall())
    return took, len(rows), compare(got, want)


def main(argv):
    from tidefolio.catalog import oracle_sql, queries
    from tidefolio.session import local_session, release

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark, con, sqls, failed = local_session(8), connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            took, n, diff = run(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            took, n, diff = 0.0, -1, f"error {type(e).__name__}: {str(e)[:600]}"
        release(spark)
        if diff and diff != "no SQL":
            failed.append(name)
        print(f"{'ok  ' if not diff else 'SKIP' if diff == 'no SQL' else 'FAIL'} {name:40s} {took:6.2f}s {n:7d} rows {diff}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
