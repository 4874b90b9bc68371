"""Run registered queries on Spark and their DuckDB statements, and compare whole results.

    python tests/oracle.py [sf] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) and not math.isnan(v):
        return f"{v:.9g}"
    return str(int(v)) if isinstance(v, int) else str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(_num(r[i])) for i in order) for r in rows)


def _num(v):
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return len(got), None
    a, b = set(got), set(want)
    return len(got), (f"{len(got)} vs {len(want)} rows; cols {sorted(cols)}; "
                      f"only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}")


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            n, diff = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            n, diff = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{name:32s} {n:8d} {time.time() - t:6.1f}s {'rows-only' if name not in sqls else ''}"
              f"{'ok' if diff is None else 'DIFF ' + diff[:900]}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
