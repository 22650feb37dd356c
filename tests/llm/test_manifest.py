"""Manifests against plain recursion and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from assayer.llm import manifest, queries

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan):
    """Root, and per leaf its (before, after) steps from the leaf up."""
    steps, groups = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        above, joined = [], []
        for a in range(0, len(leaves), fan):
            run = leaves[a:a + fan]
            for j in range(len(run)):
                for k in groups[a + j]:
                    steps[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(sha("".join(run)))
            joined.append([k for g in groups[a:a + fan] for k in g])
        leaves, groups = above, joined
    return leaves[0], steps


def brute(rows, fan):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    placed = []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        placed.append((mine, *tree([leaf(r) for r in mine], fan)))
    root, tops = tree([subroot for _, subroot, _ in placed], fan)
    out = []
    for (mine, subroot, steps), top in zip(placed, tops):
        for r, path in zip(mine, steps):
            h = leaf(r)
            f = leaf((*r[:4], r[4].translate(SMALL))) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            for before, after in path + top:
                f = sha(before + f + after)
            out.append((r[0], h, subroot, root, sha("".join(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=str)


def table(spark, rows, partitions=5):
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, at int").repartition(partitions)
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return made.withColumn("tampered_text", F.when(fifth, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def rows_of(seed, count, sources):
    r = random.Random(seed)
    rows = [(k, r.choice(sources), r.choice(["en", None, "é"]), r.choice([None, 5]), r.choice([None, "", "Text Ä", "small", "W " * 9]) if k % 3 else f"Doc {k}") for k in range(count)]
    return rows + rows[:3] + [(None, sources[0], None, None, None), (None, None, None, None, "A"), (4, sources[0], "en", 1, "Other Text"), (count + 9, "alone", "en", 0, "x" * 70000)]


@pytest.mark.parametrize("fan,count,sources", [(16, 600, ["big"] * 6 + ["", None, "Zebra", "ä", "z"]), (2, 70, ["a", "b", None]), (3, 120, [f"s{k}" for k in range(40)]), (16, 400, [f"s{k}" for k in range(300)])])
def test_manifest_equals_recursion(spark, fan, count, sources):
    rows = rows_of(fan, count, sources)
    found = [tuple(x) for x in manifest.manifest(table(spark, rows), fan).collect()]
    assert sorted(found, key=str) == brute(rows, fan)
    assert len({x[-1] for x in found}) == 2


def test_small_tables(spark):
    one = [(1, "s", "en", 3, "abc")]
    for rows in (one, one * 2, [(None, None, None, None, None)], one * 40):
        assert sorted((tuple(x) for x in manifest.manifest(table(spark, rows, 2)).collect()), key=str) == brute(rows, 16)
    empty = manifest.manifest(table(spark, one).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert all(x.verified for x in manifest.manifest(table(spark, rows_of(1, 50, ["a"])).drop("tampered_text")).collect())


def test_the_sql_says_the_same(spark, tmp_path):
    rows = rows_of(5, 500, ["big"] * 6 + ["", None, "Zebra", "ä"])
    path = f"{tmp_path}/documents.parquet"
    table(spark, rows, 1).drop("tampered_text").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        assert sorted(db.execute(queries.SQL["op12_manifest"]).fetchall(), key=str) == brute(rows, 16)
    found = queries.op12_manifest(spark, str(tmp_path))
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute(rows, 16)
