"""Dirty inputs and the registry of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

AS_OF = "2024-06-01 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def check(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in CHECKS:
        raise ValueError(f"{name} registered twice")
    CHECKS[name] = (query, sql)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# name -> (table, column expressions); the same text runs in Spark and in the SQL.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "cust": ("customer", {
        "_row_id": "c_custkey",
        "custkey": "c_custkey",
        "name": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE c_name END",
        "code": "CASE WHEN c_custkey % 13 = 0 THEN concat('X', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) WHEN c_custkey % 31 = 0 THEN NULL ELSE concat('ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F') END",
        "email": "CASE WHEN c_custkey % 17 = 0 THEN 'not-an-email' WHEN c_custkey % 19 = 0 THEN '' ELSE concat('user', CAST(c_custkey AS STRING), '@mail.example') END",
        "segment": "CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) WHEN c_custkey % 41 = 0 THEN concat(' ', c_mktsegment, '  ltd.') ELSE c_mktsegment END",
        "since": "CASE WHEN c_custkey % 23 = 0 THEN 'yesterday' WHEN c_custkey % 29 = 0 THEN NULL ELSE concat(CAST(1985 + c_custkey % 45 AS STRING), '-0', CAST(1 + c_custkey % 9 AS STRING), '-15') END",
        "amount_text": "CASE WHEN c_custkey % 10 = 0 THEN 'abc' WHEN c_custkey % 43 = 0 THEN NULL ELSE CAST(c_acctbal AS STRING) END",
        "nationkey": "c_nationkey",
        "acctbal": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN c_acctbal * 100 ELSE c_acctbal END",
    }),
    "ord": ("orders", {
        "_row_id": "o_orderkey",
        "orderkey": "o_orderkey",
        "custkey": "o_custkey",
        "status": "CASE WHEN o_orderkey % 37 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END",
        "price": "o_totalprice",
        "priority": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN '  ' ELSE o_orderpriority END",
        "ordered": "CASE WHEN o_orderkey % 97 = 0 THEN CAST('2090-01-01 00:00:00' AS TIMESTAMP) WHEN o_orderkey % 89 = 0 THEN CAST('1980-02-03 00:00:00' AS TIMESTAMP) WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END",
        "shipped": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END",
    }),
    "prt": ("part", {
        "_row_id": "p_partkey", "partkey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice",
    }),
    # The customer table after an edit: rows dropped, upper-cased, cleared, filled and added.
    "cust_after": ("customer", {
        "_row_id": "CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 10000000 ELSE c_custkey END",
        "custkey": "c_custkey",
        "name": "CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 5 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE c_name END",
        "segment": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) WHEN c_custkey % 41 = 0 THEN concat(' ', c_mktsegment, '  ltd.') ELSE c_mktsegment END",
        "email": "CASE WHEN c_custkey % 17 = 0 THEN 'not-an-email' WHEN c_custkey % 19 = 0 THEN '' ELSE concat('user', CAST(c_custkey AS STRING), '@mail.example') END",
        "nationkey": "c_nationkey + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END",
        "acctbal": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN c_acctbal * 100 ELSE c_acctbal END",
        "added": "c_custkey % 2",
    }),
    # Events under a few shared values, for matching on any column.
    "ev": ("events", {
        "_row_id": "event_id", "event_id": "event_id",
        "who": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING), '-', CAST(event_id % 40 AS STRING)) END",
        "device": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('d', CAST((event_id * 7919) % 5000 AS STRING)) END",
        "kind": "event_type", "value": "value", "at": "ts",
    }),
    "docs": ("documents", {"_row_id": "doc_id", "doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}),
    "conv": ("conversations", {"_row_id": "conv_id * 1000 + turn", "conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    "pg": ("pages", {"_row_id": "page_id", "page_id": "page_id", "url": "url", "html": "html"}),
}
# Planted copies: (view, source, condition, changes).
COPIES = {"dup": ("cust", "custkey % 20 = 0", {"_row_id": "_row_id + 10000000", "custkey": "custkey", "acctbal": "CASE WHEN custkey % 3 = 0 THEN NULL ELSE acctbal END", "since": "CASE WHEN custkey % 40 = 0 THEN '2023-12-31' ELSE since END"})}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in COPIES:
        source, condition, changes = COPIES[name]
        base = view(spark, sf, source)
        copy = base.where(condition).selectExpr(*[f"{changes.get(c, c)} AS `{c}`" for c in base.columns])
        return base.unionByName(copy)
    table, columns = VIEWS[name]
    return read(spark, sf, table).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def sql_view(name: str) -> str:
    if name in COPIES:
        source, condition, changes = COPIES[name]
        columns = list(VIEWS[source][1])
        copied = ", ".join(f'{changes.get(c, c)} AS "{c}"' for c in columns)
        listed = ", ".join('"' + c + '"' for c in columns)
        return f"{sql_view(source)}, {name} AS (SELECT {listed} FROM {source} UNION ALL SELECT {copied} FROM {source} WHERE {condition})"
    table, columns = VIEWS[name]
    listed = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {listed} FROM {table})"


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(sql_view(n) for n in names) + " "


def per_column(template: str, columns: list[str]) -> str:
    """``template`` once per column, ``{c}`` being its name."""
    return " UNION ALL ".join(f"({template.replace('{c}', c)})" for c in columns)


CUST_TEXT = ["name", "code", "email", "segment", "since", "amount_text"]
CUST_NUMBERS = ["custkey", "nationkey", "acctbal"]
CUST_ALL = ["custkey", "name", "code", "email", "segment", "since", "amount_text", "nationkey", "acctbal"]
ORD_ALL = ["orderkey", "custkey", "status", "price", "priority", "ordered", "shipped"]
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
