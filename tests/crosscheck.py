"""Runs every registered query and its SQL in DuckDB on the same tables and compares all rows.

Usage: python tests/crosscheck.py [directory] [query ...]
"""

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


def duck(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def compare(df, con, sql):
    """(what differs or None, number of rows): column types and all rows are compared."""
    result = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(result.columns):
        return f"columns {columns} / {sorted(result.columns)}", -1
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    sql_types = {n: str(t) for n, t in zip(result.columns, result.types)}
    if spark_types != sql_types:
        wrong = {n: (spark_types[n], sql_types[n]) for n in columns if spark_types[n] != sql_types[n]}
        return f"types {wrong}", -1
    position = [result.columns.index(c) for c in columns]
    want = Counter(tuple(_cell(row[i]) for i in position) for row in result.fetchall())
    got = Counter(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    if want != got:
        differing = (list((got - want).items())[:3], list((want - got).items())[:3])
        return f"rows {sum(got.values())} / {sum(want.values())}: {differing}", -1
    return None, sum(got.values())


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem, count = compare(df, con, oracles[name])
            else:
                problem, count = None, df.count()
        except Exception as error:
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} rows={count} "
              f"{time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
