"""Delimited text with line breaks, headers below other records, and stored tables."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.sources import readers, writers
from assayer.sources.stores import BaselineStore, TableStore

ROWS = [(1, 'plain'), (2, 'two\nlines'), (3, 'a "quoted",\r\n value'), (4, None), (5, 'semi;colon')]


def test_line_breaks_survive(spark, tmp_path):
    table = spark.createDataFrame(ROWS, "id long, text string")
    writers.write_csv(table, f"{tmp_path}/t")
    assert sorted(map(tuple, readers.read_table(spark, f"{tmp_path}/t", ".csv", schema=table.schema).collect())) == ROWS
    with pytest.raises(ValueError, match="line break"):
        readers.read_table(spark, f"{tmp_path}/t", ".csv", schema=table.schema, multi_line=False)


def test_names_below_other_records(spark, tmp_path):
    for name, names in (("a", "id,text"), ("b", "id,text")):
        (tmp_path / f"{name}.csv").write_text(f'report,"of\nparts"\n\nprinted by hand\n{names}\n1,"x\ny"\n2,z\n')
    found = readers.read_after_header(spark, str(tmp_path), 2)
    assert found.columns == ["id", "text"]
    assert sorted(map(tuple, found.collect())) == [("1", "x\ny"), ("1", "x\ny"), ("2", "z"), ("2", "z")]
    (tmp_path / "c.csv").write_text("report\n\nprinted\nid,other\n1,2\n")
    with pytest.raises(ValueError, match="names"):
        readers.read_after_header(spark, str(tmp_path), 2)


def test_records_across_splits_of_a_file(spark, tmp_path):
    draw = random.Random(4)
    cells = ["", "x", 'say "so"', "two\nlines", "a,b", '"', "\n\n", "r\r\nn", "é", " pad ", 'end"', "\n\",\"\n", "long " * 40 + "\n" * 30]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            out.write('\ufeff"made' + end + 'by ""hand""",,' + end + end + "k,text,more" + end)
            for i in range(60):
                line = [str(i), *('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in draw.choices(cells, k=2))]
                out.write(",".join(line) + end if i % 9 else f'{i},5" pipe,"odd"x"{end}')
    values = lambda df: sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in df.collect()), key=str)   # one task reads breaks of CRLF files as LF
    plain = values(readers._after_ids(spark, str(tmp_path), 1, ",", True, 3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = readers.read_after_header(spark, str(tmp_path), 1)
        assert found.rdd.getNumPartitions() > 10
        assert found.columns == ["k", "text", "more"] and values(found) == plain and len(plain) == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.csv").write_bytes(b'made\rk,text,more\r1,"a\nb",c\r')
    assert readers._split_records(spark, str(tmp_path / "c.csv"), 1, ",") is None
    assert [tuple(r) for r in readers.read_after_header(spark, str(tmp_path / "c.csv"), 1).collect()] == [("1", "a\nb", "c")]


def test_a_table_saved_from_itself(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.save("t", spark.range(5).toDF("x"))
    store.save("t", store.load("t").selectExpr("x + 1 AS x"))
    assert sorted(r["x"] for r in store.load("t").collect()) == [1, 2, 3, 4, 5]
    assert store.names() == ["t"]
    failing = store.load("t").selectExpr("IF(x > 2, raise_error('broken'), x) AS x")
    with pytest.raises(Exception, match="broken"):
        store.save("t", failing)
    assert store.load("t").count() == 5
    store.save("t", spark.range(2).toDF("x"))
    assert store.load("t").count() == 2


def test_baselines(spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path))
    assert store.list().count() == 0 and store.load("none") is None
    store.save("a", spark.range(1).toDF("x"))
    store.save("a", store.load("a").drop("created_at"))
    assert [r["name"] for r in store.list().collect()] == ["a"]
    assert store.delete("a") and store.list().count() == 0


def test_batches_are_written_by_few_tasks(spark, tmp_path):
    writers.write_batches(spark.range(60).select(F.col("id").alias("_row_id"), F.col("id").alias("x")), f"{tmp_path}/b", 1, ["x"], "parquet")
    files = list((tmp_path / "b").glob("batch=*/*.parquet"))
    assert len(files) == 60 and len({f.parent for f in files}) == 60
    assert len({f.name[:10] for f in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{tmp_path}/b").where("batch <> x").isEmpty()
