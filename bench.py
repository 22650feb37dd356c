"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed end to end (plan building, execution, result to a no-op sink): one
untimed run, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer import ROW_ID
from assayer.functions.formats import FORMATS, Glossary
from assayer.operators import cleanse, clusters, compare, crossfield as x, dedup, fuzzy, golden, profile, rules
from assayer.operators.cleanse import Step
from assayer.operators.rules import Rule
from assayer.plans import scorecard

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{SF_DIR}/{table}.parquet")


def with_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(ROW_ID, F.col(key).cast("bigint"))


def wide_profile(spark):
    return profile.profile(read(spark, "lineitem"))


def document_profile(spark):
    return profile.profile(read(spark, "documents"))


def scores(spark):
    glossary = Glossary({"o_orderkey": {"semantic_type": "numeric_id", "recommended": True}, "o_orderstatus": {"semantic_type": "enum_code"}, "o_orderpriority": {"semantic_type": "enum_code", "regex": r"^\d-[A-Z ]+$"}})
    orders = with_key(read(spark, "orders"), "o_orderkey")
    return scorecard.dimension_scores(orders, glossary, F.to_timestamp(F.lit("2024-06-01")), [x.composite_unique("o_custkey", "o_orderdate"), x.expression("o_totalprice < 0", ["o_totalprice"])])


def twenty_rules(spark):
    checks = [("not_blank", "l_returnflag", {}), ("not_null", "l_shipdate", {}), ("allowed_values", "l_returnflag", {"values": ["A", "N", "R"]}), ("max_length", "l_linestatus", {"length": 1}), ("uppercase", "l_linestatus", {}),
              ("lowercase", "l_returnflag", {}), ("alphanumeric", "l_returnflag", {}), ("no_special", "l_linestatus", {}), ("numeric", "l_quantity", {}), ("digits_only", "l_orderkey", {}), ("not_negative", "l_tax", {}),
              ("pattern", "l_linestatus", {"pattern": "^[OF]$"}), ("valid_date", "l_shipdate", {}), ("not_future", "l_shipdate", {"as_of": "2024-06-01"})]
    checks += [("range", c, {"low": 0, "high": h}) for c, h in (("l_quantity", 40), ("l_discount", 0.09), ("l_tax", 0.07), ("l_extendedprice", 50000), ("l_linenumber", 6))]
    made = [Rule(kind, column, params=params, rule_id=i) for i, (kind, column, params) in enumerate(checks)]
    return rules.evaluate(read(spark, "lineitem"), made + [x.arithmetic("l_extendedprice", ["l_quantity", "l_tax"], 50000, rule_id=19)])


def cleansing(spark):
    steps = [Step("l_returnflag", "Case", case="lowercase"), Step("l_returnflag", "Validate", pattern="^[an]$"), Step("l_linestatus", "Replace", pattern="O", replace="open"), Step("l_linestatus", "Length", length_mode="Maximum", max_length=4)]
    clean, quarantine = cleanse.apply(read(spark, "lineitem"), steps, "2024-06-01 00:00:00")
    return clean.unionByName(quarantine, allowMissingColumns=True)


def exact_duplicates(spark):
    lines = read(spark, "lineitem").withColumn(ROW_ID, F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return dedup.members(lines, dedup.exact_groups(lines, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


def linked_events(spark):
    events = with_key(read(spark, "events"), "event_id").withColumns({
        "who": F.expr("CASE WHEN event_id % 3 > 0 THEN concat(user_id, '-', event_id % 40) END"), "device": F.expr("CASE WHEN event_id % 4 > 0 THEN (event_id * 7919) % 50000 END")})
    return clusters.or_groups(events, ["who", "device"])


def fuzzy_documents(spark):
    """Opening lines of all documents, compared inside each language and source."""
    documents = with_key(read(spark, "documents"), "doc_id").withColumn("opening", F.substring("text", 1, 60))
    return fuzzy.fuzzy_groups(documents, "opening", 85.0, within=["lang", "source"])


def fuzzy_customers(spark):
    """Thousands of different names in one scope."""
    customers = with_key(read(spark, "customer"), "c_custkey").withColumn("label", F.concat_ws(" ", F.reverse("c_name"), "c_mktsegment"))
    return fuzzy.fuzzy_groups(customers, "label", 92.0, within=["c_nationkey"])


def golden_customers(spark):
    customers = with_key(read(spark, "customer"), "c_custkey")
    copies = customers.withColumns({ROW_ID: F.col(ROW_ID) + 10_000_000, "c_acctbal": F.lit(None).cast("double")})
    both = customers.unionByName(copies)
    groups = dedup.members(both, dedup.exact_groups(both, ["c_name", "c_nationkey"]), ["c_name", "c_nationkey"])
    return golden.golden_records(both, groups, "field_level_merge", priority=["most_complete"])


def snapshots(spark):
    before = with_key(read(spark, "orders"), "o_orderkey")
    after = before.where("o_orderkey % 10 != 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")))
    return compare.column_changes(before, after)


QUERIES = {f.__name__: f for f in (wide_profile, document_profile, scores, twenty_rules, cleansing, exact_duplicates, linked_events, fuzzy_documents, fuzzy_customers, golden_customers, snapshots)}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in QUERIES.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            query(spark).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm median of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
