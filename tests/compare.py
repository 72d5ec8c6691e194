"""Run a query and its SQL over the same tables and compare rows; also a command: python -m tests.compare DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    shared = os.environ.get("TEST_SHARED_DIR")
    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
    made = made.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", os.environ.get("TEST_WAREHOUSE", "/tmp/spark-warehouse-tests"))
    if shared:
        made = made.config("spark.checkpoint.dir", shared)
    spark = made.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x if isinstance(x, (int, str, bytes, type(None))) else float(x) if hasattr(x, "as_tuple") else str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark: SparkSession, sf_dir: str, query, sql: str) -> str:
    """Empty when both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    columns, rows = duck_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"rows {len(ours)} and {len(theirs)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__

    spark, found, sql = session(), __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in sys.argv[2:] or found:
        start = time.time()
        try:
            if name in sql:
                print(name, differences(spark, sys.argv[1], found[name], sql[name]) or "same", f"{time.time() - start:.1f} s", flush=True)
            else:
                out = found[name](spark, sys.argv[1])
                print(name, out.count(), "rows", out.dtypes, f"{time.time() - start:.1f} s", flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:1500], flush=True)
