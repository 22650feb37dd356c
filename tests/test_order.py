"""Places, exact batches, pages and ranks over many partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import compare, correlation, order
from assayer.sources import writers


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_and_totals(spark, many):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 7).alias("w"))
    rows = order.numbered(df, ["k"], "place").collect()
    assert sorted((r["k"], r["place"]) for r in rows) == [(k, k) for k in range(1000)]
    totals = {r["k"]: r["less_w"] for r in order.running_totals(df, ["k"], ["w"]).collect()}
    weights = {r["k"]: r["w"] for r in df.collect()}
    assert totals == {k: sum(weights[j] for j in range(k)) for k in range(1000)}
    assert order.numbered(df.limit(0), ["k"], "place").count() == 0


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_batches_hold_consecutive_rows(spark, many, tmp_path, file_format):
    df = spark.range(0, 950, 2).select(F.col("id").alias("_row_id"), (F.col("id") * 3).alias("a.b"), F.lit("x,\"y\"").alias("t")).repartition(9)
    writers.write_batches(df, f"{tmp_path}/b", 100, file_format=file_format)
    read = spark.read.option("header", True).option("escape", '"')
    for i in range(5):
        files = [f for f in (tmp_path / "b" / f"batch={i}").iterdir() if f.name.startswith("part-")]
        assert len(files) == 1
        got = getattr(read, file_format)(str(files[0]))
        assert got.columns == ["a.b", "t"]
        assert [int(r[0]) for r in got.collect()] == [3 * k for k in range(200 * i, min(200 * i + 200, 950), 2)]
    assert not (tmp_path / "b" / "batch=5").exists()


def test_pages(spark, many):
    before = spark.range(0, 3000, 2).select(F.col("id").alias("_row_id"), F.col("id").cast("string").alias("v"))
    after = spark.range(0, 3000, 3).select(F.col("id").alias("_row_id"), F.col("id").cast("string").alias("v"))
    ids = sorted(set(range(0, 3000, 2)) | set(range(0, 3000, 3)))
    index = compare.page_index(before, after)
    for start in (0, 700, 1990, len(ids) - 3, 5000):
        page = compare.cell_diff(before, after, ["v"], start, 10, index)
        assert sorted(r["_row_id"] for r in page.collect()) == ids[start:start + 10]
    plan = page._jdf.queryExecution().toString()
    assert "offset" not in plan.lower() and "TakeOrdered" not in plan


def ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_rank_correlation_with_nulls_and_ties(spark, table, many):
    r = random.Random(4)
    rows = [tuple(None if r.random() < gap else float(r.choice([0.0, -0.0, 1, 2, r.randint(0, 40)])) for gap in (0, 0.2, 0.5, 0, 1)) for _ in range(120)]
    rows = [(a, b, c, float("nan") if d is not None and d > 38 else d, e) for a, b, c, d, e in rows]
    found = {(x["column_a"], x["column_b"]): x["correlation"] for x in correlation.spearman(table(rows, "a double, b double, c double, `d.e` double, n double").drop("_row_id")).collect()}
    names = ["a", "b", "c", "d.e", "n"]
    missing = lambda v: v is None or v != v
    for i, p in enumerate(names):
        for j in range(i + 1, 5):
            both = [(x[i], x[j]) for x in rows if not missing(x[i]) and not missing(x[j])]
            u, v = ranks([x for x, _ in both]), ranks([y for _, y in both])
            mid = (len(both) + 1) / 2
            top, down = sum((x - mid) * (y - mid) for x, y in zip(u, v)), math.sqrt(sum((x - mid) ** 2 for x in u) * sum((y - mid) ** 2 for y in v))
            assert found[p, names[j]] == pytest.approx(top / down if down else 0.0, abs=1e-12)


def test_many_columns_are_ranked_at_once(spark):
    df = spark.range(400).select(*[((F.col("id") * (k + 3) * 37) % (101 + k)).alias(f"c{k}") for k in range(30)])
    assert correlation.spearman(df).count() == 435
