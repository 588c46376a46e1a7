"""Compare registered queries with their SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items(), key=lambda kv: str(kv[0])))
    return str(v)


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder, name, fn, sql):
    """Return (rows, seconds, problem or None)."""
    start = time.time()
    df = fn(spark, folder)
    got_rows = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got_rows), took, None if got_rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = multiset(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got_rows), took, f"columns {sorted(df.columns)} against {sorted(names)}"
    got = multiset(df.columns, got_rows)
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        sizes = f"{sum(got.values())} against {sum(want.values())} rows"
        return len(got_rows), took, f"{sizes}; only Spark {extra}; only SQL {missing}"[:1500]
    return len(got_rows), took, None if got_rows else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as contract
    from frameweave import get_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = get_session("oracle", "local[8]", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), contract.oracle_sql(), 0
    for name, fn in contract.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            rows, took, problem = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report every query
            rows, took, problem = 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        tag = "FAIL" if problem else ("ok" if name in sqls else "ok (rows)")
        print(f"{name:44s} {rows:7d} {took:6.2f}s {tag} {problem or ''}", flush=True)
    print("failures:", bad)
