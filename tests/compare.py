"""Run registered queries against their SQL twins: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int | None = None) -> SparkSession:
    cores = cores or min(8, os.cpu_count() or 1)
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("stancepanel")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows-only", len(got), t1 - t0, 0.0)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [f"{c}:{spark_types.get(c)}/{types[c]}" for c in names
           if kinds.get(spark_types.get(c), spark_types.get(c)) != types[c]]
    a, ac = _canon(got, df.columns)
    b, bc = _canon(want, names)
    if ac != bc:
        return (f"COLUMNS {ac} vs {bc}", len(got), t1 - t0, t2 - t1)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"VALUES rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}",
                len(got), t1 - t0, t2 - t1)
    return (f"TYPES {bad}" if bad else "ok", len(got), t1 - t0, t2 - t1)


def main(argv) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    spark, con, failures = session(), duck(sf_dir), 0
    for name in names:
        try:
            status, n, ts, td = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            status, n, ts, td = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0, 0.0, 0.0
        failures += status not in ("ok", "rows-only")
        print(f"{name:36s} {n:7d} rows spark {ts:6.2f}s duckdb {td:6.2f}s  {status[:900]}", flush=True)
    print(f"{len(names)} queries, {failures} failures")
    spark.stop()
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
