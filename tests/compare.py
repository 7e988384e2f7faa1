"""Run registered queries against their SQL on DuckDB and compare row for row.

``python tests/compare.py [name-prefix ...]`` prints a table of results.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return "rows", len(data), spent, dict(df.dtypes)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    got, gcols = rows_of(df.columns, data)
    want, wcols = rows_of(names, cur.fetchall())
    if gcols != wcols:
        return "COLUMNS", len(got), spent, (gcols, wcols)
    if got != want:
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        return "DIFF", len(got), spent, (gcols, f"rows {len(got)} vs {len(want)}", only_got, only_want)
    types = {d[0]: str(d[1]) for d in cur.description}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if pairs.get(t) not in (types[c], None) or t not in pairs}
    return "ok", len(got), spent, odd or ""


def main(prefixes):
    import __spark_entry__ as entry
    from matchloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, n, spent, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, n, spent, note = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:42} {n:8} {spent:6.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
