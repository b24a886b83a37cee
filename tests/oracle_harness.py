"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Comparison follows the driver's contract: column names sorted, row count,
order-insensitive multiset of rows.  Doubles are compared after rounding to
6 decimals (the registered queries already round for presentation).
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    s_norm, s_sorted = _rows(s_cols, s_rows)
    d_norm, d_sorted = _rows(d_cols, d_rows)
    ok_schema = s_sorted == d_sorted
    ok_count = len(s_norm) == len(d_norm)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    ok_vals = ok_count and sorted(s_norm, key=key) == sorted(d_norm, key=key)
    info = dict(name=name, schema=ok_schema, count=ok_count, values=ok_vals,
                spark_rows=len(s_norm), duck_rows=len(d_norm), sec=round(t1 - t0, 2))
    if not (ok_schema and ok_vals):
        info["spark_cols"] = s_sorted
        info["duck_cols"] = d_sorted
        ss, dd = set(s_norm), set(d_norm)
        info["only_spark"] = sorted(ss - dd, key=key)[:3]
        info["only_duck"] = sorted(dd - ss, key=key)[:3]
    return info


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tabsmith.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    names = argv or sorted(E.oracle_sql())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            t0 = time.time()
            cnt = qs[n](spark, sf_dir).count()
            print(f"ROWS-ONLY {n}: {cnt} rows {time.time()-t0:.1f}s", flush=True)
            continue
        try:
            info = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # noqa
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        ok = info["schema"] and info["values"]
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(info), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
