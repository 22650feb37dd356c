"""Low thresholds: one text against many in machine words, and whole scopes in sweeps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import many
from assayer.functions.similarity import SCORERS, ratio
from assayer.operators import fuzzy

from tests.test_similarity import sequential, words

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("texts", [words(1, 150), words(2, 45, "abcdefgh好ü🙂", 150), ["ab" * 600, "ba" * 530, "x", "abx"] + words(3, 15, "ab", 20)])
@pytest.mark.parametrize("algorithm", ["ratio", "difflib", "jaro_winkler", "combined"])
def test_every_pair_over_the_threshold_is_found(texts, algorithm):
    texts = [t for t in texts if t]
    found, alive = many.Many(texts), np.ones(len(texts), bool)
    alive[::5] = False
    for threshold in (50, 70, 88, 100):
        for k in range(0, len(texts), 6):
            exact = {j: SCORERS[algorithm](texts[k], t) for j, t in enumerate(texts) if j % 5}
            assert dict(found.reach(texts[k], alive, algorithm, threshold)) == pytest.approx({j: v for j, v in exact.items() if v >= threshold})


def test_masks_are_bounded(monkeypatch):
    monkeypatch.setattr(many, "MASK_BYTES", 4096)
    texts = [t for t in words(4, 120, "abcdefghijkl", 70) if t]
    found = many.Many(texts)
    assert len(found.chunks) > 3 and all(c.masks.nbytes <= 4096 or len(c.rows) == 1 for c in found.chunks)
    assert dict(found.reach(texts[3], np.ones(len(texts), bool), "ratio", 60)) == pytest.approx({j: ratio(texts[3], t) for j, t in enumerate(texts) if ratio(texts[3], t) >= 60})


@pytest.fixture(scope="module")
def openings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("_row_id"), F.substring("text", 1, 60).alias("v")).where("v IS NOT NULL").orderBy("_row_id")
    return docs, [(r["_row_id"], r["v"]) for r in docs.collect()]


@pytest.mark.parametrize("threshold,heads", [(70.0, 1024), (60.0, 90)])
def test_openings_equal_a_sequential_run(spark, openings, threshold, heads):
    df, rows = openings
    forms = [r["f"] for r in df.select(fuzzy.text.normal_form(F.col("v")).alias("f"), "_row_id").orderBy("_row_id").collect()]
    ids = [i for i, _ in rows]
    expected = {ids[k]: ids[leader] for k, leader in sequential(forms, ratio, threshold).items()}
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", threshold, heads=heads).collect()}
    assert found == expected and len(set(expected.values())) > 20


def test_few_pairs_are_scored_to_the_end(openings):
    texts = sorted({" ".join(v.lower().split()) for _, v in openings[1]} - {""})
    everything, ended, alive = many.Many(texts), 0, np.ones(len(texts), bool)
    for text in texts[:200]:
        ended += len(everything.reach(text, alive, "ratio", 70))
    assert ended < 0.05 * 200 * len(texts)


def test_several_columns_and_tiles(table, monkeypatch):
    monkeypatch.setattr(fuzzy, "TILE", 7)
    a, b = words(5, 80), words(6, 80)
    r = random.Random(1)
    scope = [r.choice(["x", "y", None]) for _ in a]
    found = fuzzy.fuzzy_groups_on(table(list(zip(a, b, scope)), "a string, b string, s string"), {"a": ("ratio", 55.0), "b": ("jaro_winkler", 60.0)}, within=["s"], heads=4)
    both = lambda x, y: min(ratio(x[0], y[0]) - 55, SCORERS["jaro_winkler"](x[1], y[1]) - 60)
    rows = [(x, y) if x and y and s else None for x, y, s in zip(a, b, scope)]
    leaders, owner = [], {}
    for k, row in enumerate(rows):
        if row is None:
            continue
        hit = next((j for j in leaders if scope[j] == scope[k] and both(rows[j], row) >= 0), None)
        owner[k] = k if hit is None else hit
        if hit is None:
            leaders.append(k)
    sizes = {j: sum(o == j for o in owner.values()) for j in leaders}
    assert {x["_row_id"]: x["group_id"] for x in found.collect()} == {k: j for k, j in owner.items() if sizes[j] > 1}


def test_jaro_winkler_of_short_texts_needs_no_scoring_one_by_one(monkeypatch):
    texts = sorted({t for t in words(7, 300, "abcdef", 12) + words(8, 60, "abü", 64) if t})
    found, exact = many.Many(texts), SCORERS["jaro_winkler"]
    calls = []
    monkeypatch.setitem(many.SCORERS, "jaro_winkler", lambda a, b: calls.append(a) or exact(a, b))
    for text in texts[::7] + ["x" * 70, "ab" * 40]:
        for threshold in (60.0, 90.0):
            expected = {k: value for k, t in enumerate(texts) if (value := exact(text, t)) >= threshold}
            assert dict(found.reach(text, np.ones(len(texts), bool), "jaro_winkler", threshold)) == expected
    assert not calls


def test_windows_are_only_matched_where_shared_characters_reach(monkeypatch):
    texts = ["ab" + t for t in words(9, 400, "cdefghijklmnop", 10)]
    met, matching = [], many.Chunk.matching
    monkeypatch.setattr(many.Chunk, "matching", lambda self, text, chosen: met.append(len(chosen)) or matching(self, text, chosen))
    everything = many.Many(texts)
    for text in texts[:50]:
        everything.reach(text, np.ones(len(texts), bool), "jaro_winkler", 90.0)
    assert sum(met) < 0.2 * 50 * len(texts)


def test_scopes_and_tiles_stay_spread_over_tasks(spark, table, monkeypatch):
    plans, write = [], fuzzy.cut
    monkeypatch.setattr(fuzzy, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rows = [(t, t[0]) for t in words(10, 90) if t]
    found = fuzzy.fuzzy_groups(table(rows, "v string, s string"), "v", 90.0, "jaro_winkler", within=["s"], heads=3)
    assert found.count()
    worked = [p for p in plans if "GroupsInPandas" in p]
    assert worked and all("REPARTITION_BY_NUM" in p for p in worked)
