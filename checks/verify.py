"""Run registered queries beside their SQL and compare the answers: ``python -m checks.verify [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def duck_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def as_counter(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str):
    """``None`` when Spark and the SQL agree, else what differs."""
    df = query(spark, sf_dir)
    columns, rows = duck_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = as_counter(df.columns, df.collect()), as_counter(columns, rows)
    if got != want:
        return f"{sum(got.values())} rows vs {sum(want.values())}; only Spark {list((got - want))[:3]}; only SQL {list((want - got))[:3]}"
    return None


def main() -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                wrong = compare(spark, sf_dir, QUERIES[name], ORACLE[name])
            else:
                wrong = None if QUERIES[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {time.time() - start:6.2f}s {name}{'' if wrong is None else ' -> ' + wrong}", flush=True)
    print(f"{bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(main())
