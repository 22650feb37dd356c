from pyspark.sql import functions as F

from assayer.llm import merkle


def pages(spark, n=90):
    rows = [(i, f"http://h/{i}", "é" * (i * 37 % 900) + str(i), "x", 1) for i in range(n)] + [(None, None, None, "x", 1), (7, "http://h/7", "again", "x", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset int").repartition(3)


def test_damage_is_located(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 700)
    monkeypatch.setattr(merkle, "FAN", 3)
    primary = merkle.archive(pages(spark), per_file=25).cache()
    changed = F.col("id").isin(3, 50)
    replica = primary.withColumn("digest", F.when(changed, F.sha2("digest", 256)).otherwise(F.col("digest"))).where("id IS NULL OR id != 60")
    replica = replica.unionByName(primary.where("id = 20").withColumn("offset", F.col("offset") + 1))
    expected = {(x.file, x.offset, "changed") for x in primary.where(changed).collect()} | {(x.file, x.offset, "missing") for x in primary.where("id = 60").collect()}
    expected |= {(x.file, x.offset + 1, "extra") for x in primary.where("id = 20").collect()}
    assert {(x.file, x.offset, x.status) for x in merkle.audit(primary, replica).collect()} == expected
    assert merkle.audit(primary, primary).count() == 0
    assert merkle.height(primary) >= 2


def test_a_lost_file_and_empty_archives(spark):
    primary = merkle.archive(pages(spark), per_file=25).cache()
    lost = merkle.audit(primary, primary.where("file != 2 OR file IS NULL"))
    assert lost.where("status = 'missing'").count() == primary.where("file = 2").count() == lost.count()
    assert merkle.audit(primary.limit(0), primary.limit(0)).count() == 0
    assert merkle.audit(primary.limit(0), primary).where("status = 'extra'").count() == primary.count()


def test_records_follow_each_other(spark):
    rows = merkle.archive(pages(spark), per_file=25).orderBy("file", "offset").collect()
    for a, b in zip(rows, rows[1:]):
        assert b.offset == (a.offset + a.length if a.file == b.file else 0)


def test_roots_depend_on_every_record_only(spark):
    primary = merkle.archive(pages(spark), per_file=25).cache()
    levels = merkle.height(primary)
    one, two = (sorted(map(tuple, merkle.build(t, levels).roots.collect())) for t in (primary, primary.repartition(5)))
    assert one == two and len(one) == 5
