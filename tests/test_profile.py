"""Profile, quantiles, drift, plans that must hold at scale, streaming, registered checks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import dedup, drift, profile, quantiles, values
from assayer.operators.cleanse import Step
from assayer.operators.rules import Rule
from assayer.plans import library
from assayer.sources import stores
from assayer.streaming import quarantine

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sketch, buffer", [(100_000, 500_000), (20, 10)])
def test_quantiles_are_exact(spark, monkeypatch, sketch, buffer):
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "BUFFER_VALUES", buffer)
    rng = np.random.default_rng(3)
    data = {"even": rng.normal(size=900), "skewed": rng.exponential(size=900) ** 6, "hot": np.where(rng.random(900) < 0.4, 7.0, rng.random(900))}
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in data) for i in range(900)], "even double, skewed double, hot double")
    found = quantiles.exact_quantiles(df, list(data), [0.25, 0.5, 0.75])
    for c in data:
        assert found[c] == pytest.approx(list(np.quantile(data[c], [0.25, 0.5, 0.75])), rel=1e-12)


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/part.parquet")
    rows = lambda d: sorted(map(str, profile.profile(d).drop("q1", "q3").collect()))
    assert rows(df.repartition(1)) == rows(df.repartition(7))


def test_nested_columns_are_counted_only(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["embedding"]["null_count"] == 0 and rows["embedding"]["distinct_count"] is None


def test_scan_reads_only_its_columns(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = plan(profile.scan(df, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_first_values_keep_a_heap(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").withColumn("_row_id", F.col("o_orderkey"))
    text = plan(values.first_values(df, ["o_orderstatus"], 3))
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(o_orderstatus)]" in text


@pytest.mark.parametrize("columns", [["p_name"], ["p_name", "p_brand"]])
def test_top_values_keep_a_heap(spark, columns):
    df = spark.read.parquet(f"{SF}/part.parquet")
    assert plan(values.top_values(df, columns, 5)).count("TakeOrderedAndProject") == len(columns)


def test_group_details_are_limited_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/part.parquet").withColumn("_row_id", F.col("p_partkey"))
    groups = dedup.members(df, dedup.exact_groups(df, ["p_name"]), ["p_name"])
    assert "WindowGroupLimit" in plan(dedup.details(df, groups, 5))


def test_drift(table):
    old = table([(float(i), "a", "x") for i in range(50)], "n double, gone string, s string")
    new = table([(float(i) + 500, "a", None if i % 2 else "x") for i in range(50)], "n double, fresh string, s string")
    found = {(r["column"], r["type"]) for r in drift.detect(drift.baseline(new), drift.baseline(old)).collect()}
    assert found == {("n", "mean_shift"), ("gone", "missing_column"), ("fresh", "new_column"), ("s", "null_rate")}
    assert drift.detect(drift.baseline(old), drift.baseline(old)).count() == 0


def test_versions(spark, table, tmp_path):
    store = stores.VersionStore(spark, str(tmp_path / "v"))
    store.start(table([(i,) for i in range(10)], "n int"))
    work = lambda: sorted(r["n"] for r in store.working().collect())
    split = lambda cut: (store.working().where(f"n >= {cut}"), store.working().where(f"n < {cut}"))
    store.commit(*split(2), "first")
    store.commit(*split(5), "second")
    assert work() == list(range(5, 10)) and store.rejected().count() == 5
    assert store.undo() and work() == list(range(2, 10)) and store.rejected().count() == 2
    store.commit(*split(4), "third")
    assert work() == list(range(4, 10)) and store.rejected().count() == 4
    store.reset()
    assert work() == list(range(10)) and store.rejected() is None and not store.undo()
    with pytest.raises(Exception):
        store.start(store.working())


def test_library_needs_its_columns(table):
    df = table([("a", "1")], "vendor_name string, pan string")
    with pytest.raises(KeyError):
        library.scan(df, "vendor-domestic-name-pan-gst")
    assert library.resolve_columns(df, "employee-exact-national-id", {"national_id": "PAN"}) == {"national_id": "pan"}
    assert len(library.RULES) == 12


def test_fuzzy_library_rule(table):
    df = table([("Bolt M8 50mm", "A"), ("M8 50mm bolt", "A"), ("M8 50mm bolt", "B"), ("Nut M8", "A")], "material_description string, material_group string")
    rows = library.scan(df, "material-fuzzy-description-category").collect()
    assert sorted((r["_row_id"], r["group_id"]) for r in rows) == [(0, 0), (1, 0)]


def test_stream_is_split(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(40).select(F.col("id"), F.when(F.col("id") % 4 == 0, "bad!").otherwise("good").alias("v"), F.timestamp_seconds(F.col("id") * 600).alias("at"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    run = quarantine.cleanse_stream(stream, [Step("v", "Case"), Step("v", "Validate", pattern="^[A-Z]+$")], str(tmp_path / "clean"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 30
    assert {r["v"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"BAD!"}
    hourly = quarantine.windowed_issues(rows, "at", [Rule("alnum_strict", "v", rule_id=1)])
    assert hourly.agg(F.sum("rule_1"), F.sum("rows")).first()[:] == (10, 40)


SAMPLE = ["A01_null_counts", "A09_outliers", "A22_column_profile", "A32_spearman", "A33_match_rules_cust", "D04_validation_fields", "D07_uniqueness_score", "D16_spelling_variants", "D23_executive_summary", "D26_field_scores", "R16_all_rules_one_scan", "R16_rules_with_examples",
          "R25_multi_unique_or", "R39_rule_status", "X07_all_cross_rules", "C07_apply_clean", "C07_apply_quarantine", "C12_undo", "C14_deduplicate_kept", "M03_column_changes", "M04_cell_diff", "G01_drift_alerts", "S06_header_offset", "K01_write_csv", "J01_working_view",
          "U01_exact_members", "U08_fuzzy_groups_85", "U11_any_column_equal", "U14_merge", "U18_field_level_merge", "U20_apply_survivors", "U22_duplicate_matrix"]


def names():
    from checks import CHECKS

    return list(CHECKS) if os.environ.get("ALL_CHECKS") else SAMPLE


@pytest.fixture(scope="module")
def database():
    from checks import harness

    return harness.database(SF)


@pytest.mark.parametrize("name", names())
def test_registered_check(spark, database, name):
    """A sample of the registered queries; ALL_CHECKS=1 runs every one."""
    from checks import CHECKS, harness

    query, sql = CHECKS[name]
    assert harness.compare(spark, database, SF, query, sql) == ""
