"""Run registered queries and compare them with their SQL: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def difference(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    left_names, left = canonical(spark_columns, spark_rows)
    right_names, right = canonical(sql_columns, sql_rows)
    if left_names != right_names:
        return f"columns {left_names} vs {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"
    for a, b in zip(left, right):
        if a != b or repr(a) != repr(b):
            return f"{left_names}: {a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            rows = [tuple(row) for row in frame.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(rows)} rows, {took:.2f}s")
                continue
            start = time.time()
            result = con.execute(ORACLES[name])
            expected = result.fetchall()
            problem = difference(frame.columns, rows, [c[0] for c in result.description], expected)
            sql_took = time.time() - start
            print(f"{'FAIL ' if problem else 'ok   '} {name}: {len(rows)} rows, {took:.2f}s, sql {sql_took:.2f}s {problem or ''}")
            failed += bool(problem)
        except Exception as error:  # report and go on with the next query
            failed += 1
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:600]}")
        sys.stdout.flush()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
