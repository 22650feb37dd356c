"""Run checks against DuckDB: ``python -m checks.harness <sf_dir> [name prefix ...]``."""

from __future__ import annotations

import decimal
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def database(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, sf, query, sql):
    """Empty text when both sides agree."""
    df = query(spark, sf)
    columns, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if mine else "no rows"
    result = db.execute(sql)
    names, theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} vs {len(theirs)} rows; spark {only_mine}; sql {only_theirs}"
    return "" if mine else "empty on both sides"


def main(sf: str, prefixes: list[str]) -> int:
    from checks import CHECKS

    spark, db, bad = session(), database(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, (query, sql) in CHECKS.items():
        if prefixes and not any(name.startswith(x) for x in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, db, sf, query, sql)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if len(prefixes) == 1 and prefixes[0] == name:
                traceback.print_exc()
        bad += bool(problem)
        if problem or prefixes or time.time() - start > 8:
            print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if sql else '(rows only) '}{problem[:900]}", flush=True)
    print(f"{len(CHECKS)} registered, {bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
