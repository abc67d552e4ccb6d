"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return f"{type(v).__name__}:{v!r}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    got_rows = spark_df.collect()
    got = rows_of(spark_df.columns, got_rows)
    if sorted(want_cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(want_cols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None), len(got)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from voltide.session import get_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    import os

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false --conf spark.driver.memory=8g pyspark-shell")
    spark = get_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    failed = []
    for n in names:
        t0 = time.time()
        try:
            if n in sqls:
                msg, k = compare(qs[n](spark, sf), con, sqls[n])
            else:
                k, msg = len(qs[n](spark, sf).collect()), None
        except Exception as e:  # report and go on
            msg, k = f"{type(e).__name__}: {str(e)[:900]}", -1
        print(f"{'FAIL' if msg else 'ok  '} {n:34s} rows={k:6d} {time.time() - t0:6.2f}s {'' if n in sqls else '(no sql)'} {msg or ''}", flush=True)
        if msg:
            failed.append(n)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
