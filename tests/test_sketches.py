"""Quantiles, baselines, characters and the search index against plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import characters, drift, profile, quantiles, select
from assayer.sources.search import SearchStore, grams_of, ranges


@pytest.mark.parametrize("room", [500_000, 0])
def test_quantiles_in_either_way(spark, monkeypatch, room):
    monkeypatch.setattr(quantiles, "BUFFER_VALUES", room)
    r = random.Random(3)
    rows = [(float(r.choice([0, 1, 1, 2, r.gauss(0, 50)])), r.randint(-5, 5), None if r.random() < 0.7 else r.random(), None, float("nan") if i % 9 == 0 else float(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "`a.b` double, b int, c double, n double, f double").repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, df.columns, probabilities)
    for i, c in enumerate(df.columns):
        values = [x[i] for x in rows if x[i] is not None and not math.isnan(x[i])]
        expected = np.quantile(values, probabilities).tolist() if values else [None] * 5
        assert found[c] == (pytest.approx(expected, abs=1e-9) if values else expected)
    state = quantiles.sketches(df, df.columns)
    assert quantiles.exact_quantiles(df, ["b"], [0.5], state)["b"] == [np.median([x[1] for x in rows])]


def test_a_wrong_bracket_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "brackets", lambda state, p: {"id": (1000, 0.0, 999.0, [(0.0, 1.0)] * len(p))})
    assert quantiles.exact_quantiles(spark.range(1000), ["id"], [0.5])["id"] == [499.5]


def test_hundreds_of_columns(spark):
    df = spark.range(3000).select(*[((F.col("id") * (k + 7)) % 1009).cast("double").alias(f"c{k}") for k in range(300)])
    found = quantiles.exact_quantiles(df, df.columns, [0.25, 0.75])
    for k in (0, 150, 299):
        assert found[f"c{k}"] == pytest.approx(np.quantile([(i * (k + 7)) % 1009 for i in range(3000)], [0.25, 0.75]).tolist())


def test_merged_baselines_equal_one_of_the_whole(spark):
    r = random.Random(8)
    rows = [(i, r.gauss(5, 2) if r.random() < 0.9 else None, r.choice("abcdef"), None) for i in range(3000)]
    make = lambda some: drift.baseline(spark.createDataFrame(some, "k long, v double, t string, n double"), mergeable=True)
    whole = {x["column"]: x for x in make(rows).collect()}
    merged = drift.merge(drift.merge(make(rows[:700]), make(rows[700:1900])), make(rows[1900:]))
    for x in merged.collect():
        w = whole[x["column"]]
        for c in ("row_count", "null_count", "min", "max", "null_percentage"):
            assert x[c] == w[c]
        assert x["mean"] == (None if w["mean"] is None else pytest.approx(w["mean"])) and x["std"] == (None if w["std"] is None else pytest.approx(w["std"]))
        assert abs(x["distinct_count"] - w["distinct_count"]) <= 0.02 * w["distinct_count"]
        assert (x["median"] is None) == (w["median"] is None)
    near = {x["column"]: x["median"] for x in merged.collect()}
    assert abs(near["k"] - 1499.5) < 0.01 * 3000
    assert drift.detect(merged, make(rows)).count() == 0
    exact = quantiles.exact_quantiles(spark.createDataFrame(rows, "k long, v double, t string, n double"), ["k"], [0.5], merged.selectExpr("column", "row_count - null_count AS n", "min AS low", "max AS high", "quantiles AS sketch"))
    assert exact == {"k": [1499.5]}


def test_characters_and_symbols(spark, monkeypatch):
    monkeypatch.setattr(characters, "PART", 64)
    r = random.Random(5)
    rows = [("".join(r.choice(["a", "Z", "7", " ", "  ", "\t", "_", "__", "é", "好", "🙂", "\x00", "!", ".", "'", "\\", " "]) for _ in range(r.randint(0, 30))), None if i % 5 else "x.y!") for i in range(300)]
    df = spark.createDataFrame(rows + [(None, "")], "`S.No` string, b string").repartition(4)
    found = {(x["column"], x["character"]): (x["occurrences"], x["code_point"], x["unicode_name"]) for x in profile.character_frequency(df).collect()}
    expected = {}
    for i, c in enumerate(df.columns):
        for ch, n in Counter("".join(x[i] or "" for x in rows)).items():
            if not re.match(r"[A-Za-z0-9 \t\n\x0b\f\r]", ch):
                expected[c, ch] = (n, ord(ch), unicodedata.name(ch, "UNKNOWN"))
    assert found == expected
    symbols = {(x["column"], x["symbol"]): x["rows"] for x in profile.special_characters(df).collect()}
    plain = {}
    for i, c in enumerate(df.columns):
        values = [x[i] for x in rows if x[i]]
        for symbol, _ in profile.SYMBOLS:
            plain[c, symbol] = sum(symbol in v for v in values)
        plain[c, "  "] = sum(bool(re.search(r"[ \t\n\x0b\f\r]{2,}", v)) for v in values)
        plain[c, "__"] = sum("__" in v for v in values)
    assert symbols == {k: n for k, n in plain.items() if n}


def test_search_through_the_index(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(8)), r.randint(0, 10**6), None if k % 3 else f"Nr. {k}") for k in range(5000)]
    rows[4321] = (4321, "here is the RARE needle, Über alles", 5, None)
    df = spark.createDataFrame(rows, "_row_id long, `text.a` string, n int, c string").repartition(6)
    store = SearchStore(spark, str(tmp_path), block=50)
    store.save("t", df)
    assert sorted(map(tuple, store.load("t").collect())) == rows
    for needle, columns in [("rare NEEDLE", None), ("über", None), ("nr. 432", None), ("nr. 432", ["c"]), ("abc", ["text.a"]), ("zzz", None), ("12", None), ("", None), ("ab", ["c"]), ("999", ["n"])]:
        expected = sorted(map(tuple, select.search(df, needle, columns).collect()))
        assert sorted(map(tuple, store.search("t", needle, columns).collect())) == expected
    assert store.blocks("t", "rare needle") == [86] and store.blocks("t", "ab") is None and store.blocks("t", "zzz") == []
    plan = store.search("t", "rare needle")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*_block", plan)


def test_ranges_join_over_the_smallest_gaps():
    assert ranges([1, 2, 3, 7, 8, 20], 10) == [(1, 3), (7, 8), (20, 20)]
    assert ranges([1, 2, 3, 7, 8, 20], 2) == [(1, 8), (20, 20)]
    assert ranges([], 3) == [] and grams_of("ab") == [] and len(grams_of("aaaa")) == 1
