"""Equal rows counted by digest, and versions merged when read."""

import pytest
from pyspark.sql import functions as F

from assayer.functions.formats import Glossary
from assayer.operators import cleanse, dedup, digests
from assayer.operators.cleanse import Step
from assayer.plans import reports, scorecard
from assayer.sources.versions import VersionStore


def test_nulls_and_columns_are_told_apart(table):
    rows = [(None, "a"), ("a", None), ("a", None), (None, None), (None, None), ("", None), ("a", "a"), ("a", "a"), ("a", "a")]
    df = table(rows, "`x.y` string, z string")
    found = digests.repetition(df, [(["x.y", "z"], "none"), (["x.y", "z"], "all"), (["x.y", "z"], "any"), (["z"], "any")]).orderBy("key_set").collect()
    assert [tuple(r)[1:] for r in found] == [(9, 5, 7, 3), (7, 4, 5, 2), (3, 1, 3, 1), (4, 1, 4, 1)]
    groups = dedup.exact_groups(df)
    assert sorted((r["group_id"], r["rows"], r["x.y"], r["z"]) for r in groups.collect()) == [(1, 2, "a", None), (6, 3, "a", "a")]
    by_value = dedup.exact_groups(df, ["x.y", "z"], by_digest=False)
    assert sorted((r["group_id"], r["rows"], r["x.y"], r["z"]) for r in by_value.collect()) == [(1, 2, "a", None), (6, 3, "a", "a")]
    assert sorted((r["_row_id"], r["group_id"]) for r in dedup.members(df, groups, ["x.y", "z"]).collect()) == [(1, 1), (2, 1), (6, 6), (7, 6), (8, 6)]
    assert sorted(r["_row_id"] for r in dedup.remove_exact(df, keep="last").collect()) == [0, 2, 4, 5, 8]
    assert digests.repetition(df.limit(0), [(["z"], "any")]).first()[1:] == (0, 0, 0, 0)


def test_zeros_and_nan_are_equal_as_in_grouping(table):
    df = table([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)], "v double")
    assert digests.repetition(df, [(["v"], "none")]).first()[1:] == (5, 3, 4, 2)


def test_long_texts_are_not_shuffled(spark):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.repeat(F.lit("w "), 5000).alias("text"), F.col("id").cast("string").alias("code"))
    for plan in (digests.repetition(df, [(["text", "code"], "none")]), reports.shared_identifiers(df, ["code"]), scorecard.uniqueness(df, Glossary({}))):
        exchanges = [line for line in plan._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("\n") if "Exchange" in line]
        assert exchanges and not any("text#" in line for line in exchanges)


def test_shared_identifiers_of_several_columns(table):
    df = table([("p1", "e1", "a"), ("p1", "e2", "a"), ("p1", "e1", "a"), ("p2", "e3", "b"), ("p2", "e3", "b"), (None, "e3", "c")], "pan string, email string, name string")
    found = sorted(tuple(r) for r in reports.shared_identifiers(df, ["pan", "email"]).collect())
    assert found == [("email", "e3", 2, 3), ("pan", "p1", 2, 3)]
    assert sorted(tuple(r) for r in reports.shared_risk(df, ["pan", "email", "name"]).select("column", "shared_values", "rows_affected").collect()) == [("email", 1, 3), ("name", 1, 3), ("pan", 1, 3)]


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def wide(spark, rows=4000):
    return spark.range(rows).select(F.col("id").alias("_row_id"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"t.{k}") for k in range(8)], F.col("id").alias("n"),
                                    F.when(F.col("id") % 3 == 0, F.create_map(F.lit("k"), F.col("id"))).alias("m"))


def test_a_step_writes_what_it_changes(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    store.start(wide(spark))
    expected = {r["_row_id"]: r.asDict() for r in wide(spark).collect()}
    edit = lambda df: (df.withColumn("t.3", F.when(F.col("n") % 100 == 5, F.upper("`t.3`")).otherwise(F.col("`t.3`"))).where("n % 400 <> 7"), df.where("n % 400 = 7"))
    step = store.apply(edit, "one in a hundred")
    for k in [k for k in expected if k % 400 == 7]:
        del expected[k]
    for k, row in expected.items():
        row["t.3"] = row["t.3"].upper() if k % 100 == 5 else row["t.3"]
    assert {r["_row_id"]: r.asDict() for r in store.working().collect()} == expected
    assert size(tmp_path / "changes" / f"step={step}") < 0.02 * size(tmp_path / "working" / "step=0")
    assert store.rejected().count() == 10 and "_before_step" not in store.rejected().columns


@pytest.mark.parametrize("compact_after", [2, 16])
def test_steps_undo_and_new_rows(spark, tmp_path, compact_after):
    store = VersionStore(spark, str(tmp_path), compact_after)
    state = {i: {"v": str(i), "w": i} for i in range(50)}
    frame = lambda rows: spark.createDataFrame([(i, r["v"], r["w"]) for i, r in rows.items()], "_row_id long, v string, w int")
    store.start(frame(state))
    versions = [state]

    def step(made):
        lost = {i: r for i, r in versions[-1].items() if i not in made}
        store.commit(frame(made), frame(lost), "edit")
        versions.append(made)
        shown()

    def shown():
        assert {r["_row_id"]: {"v": r["v"], "w": r["w"]} for r in store.working().collect()} == versions[-1]
    step({i: r | {"v": None if i % 10 == 1 else r["v"]} for i, r in versions[-1].items()})
    step({i: r | {"w": r["w"] + 100 if i % 7 == 0 else r["w"]} for i, r in versions[-1].items() if i % 5})
    step(versions[-1] | {5: {"v": "back", "w": None}, 900: {"v": "new", "w": 1}})
    step({i: r | {"v": "again" if i in (5, 900, 11) else r["v"]} for i, r in versions[-1].items() if i != 7})
    assert store.rejected().count() == 11
    store.undo()
    versions.pop()
    shown()
    step({i: r for i, r in versions[-1].items() if i != 900})
    store.reset()
    versions[:] = versions[:1]
    shown()


def test_a_step_may_change_columns(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    store.start(spark.createDataFrame([(1, "a", 2), (2, "b!", 3)], "_row_id long, v string, n int"))
    store.apply(lambda df: cleanse.apply(df, [Step("v", "Case"), Step("v", "Validate", pattern="^[A-Z]+$")], "2024-01-01"), "upper")
    assert [tuple(r) for r in store.working().collect()] == [(1, "A", 2)]
    store.apply(lambda df: (df.drop("n").withColumn("more", F.lit(1)), df.limit(0)), "other columns")
    assert [r.asDict() for r in store.working().collect()] == [{"_row_id": 1, "v": "A", "more": 1}]
    store.undo()
    assert [tuple(r) for r in store.working().collect()] == [(1, "A", 2)]


def test_sets_behind_their_subsets_cost_nothing(table, monkeypatch):
    rows = [(["x", "y", "", None, "NA", "z"][i % 6], f"c{i % 7}" if i % 4 else None, f"u{i % 14}", f"v{i}") for i in range(60)]
    df, counted, sizes = table(rows, "a string, b string, c string, d string"), [], dedup.group_sizes
    sets = [("c+d", ["c", "d"]), ("a", ["a"]), ("a+b", ["a", "b"]), ("b+c", ["b", "c"]), ("c", ["c"]), ("a+c", ["a", "c"]), ("all", ["a", "b", "c", "d"])]
    monkeypatch.setattr(dedup, "group_sizes", lambda rows, *rest: counted.append(rows.count()) or sizes(rows, *rest))
    found = {r["_row_id"]: (r["match_order"], r["matched_by"]) for r in dedup.duplicate_matrix(df, sets).collect()}
    expected = {}
    for n, (label, keys) in reversed(list(enumerate(sets))):
        held = {}
        for i, row in enumerate(rows):
            values = tuple(row["abcd".index(k)] for k in keys)
            if all(v not in ("", None, "NA") for v in values):
                held.setdefault(values, []).append(i)
        expected |= {i: (n, label) for ids in held.values() if len(ids) > 1 for i in ids}
    assert found == expected and {n for n, _ in expected.values()} == {1, 3, 4}
    assert sum(counted) <= 4 * len(rows)
