"""Similarity scores, fuzzy groups against a sequential run, linked rows."""

import difflib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from assayer.functions.phonetics import double_metaphone
from assayer.functions.similarity import SCORERS, common_subsequence, jaro_winkler, ratio
from assayer.operators import clusters, fuzzy, golden, dedup
from assayer.operators.skew import attach, group_sizes


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_scores():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert common_subsequence(a, b) == slow_lcs(a, b)
        if a or b:
            assert difflib.SequenceMatcher(None, a, b).ratio() * 100 <= ratio(a, b) + 1e-9
    assert round(jaro_winkler("martha", "marhta"), 2) == 96.11
    assert round(jaro_winkler("dixon", "dicksonx"), 2) == 81.33
    assert ratio("acme corp", "acme corporation") == pytest.approx(72.0)


@pytest.mark.parametrize("word, codes", [
    ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Thomas", ("TMS", "")), ("Michael", ("MKL", "MXL")), ("Catherine", ("K0RN", "KTRN")),
    ("Richard", ("RXRT", "RKRT")), ("Xavier", ("SF", "SFR")), ("Laugh", ("LF", "")), ("Nation", ("NXN", "")), ("Knight", ("NT", "")), ("123", ("", "")),
])
def test_phonetic_codes(word, codes):
    assert double_metaphone(word) == codes


def sequential(texts, scorer, threshold, within=None):
    """Row by row: join the first earlier leader that is close enough."""
    leaders, owner = [], {}
    for i, value in enumerate(texts):
        if not value:
            continue
        for leader in leaders:
            if (within is None or within[leader] == within[i]) and scorer(texts[leader], value) >= threshold:
                owner[i] = leader
                break
        else:
            leaders.append(i)
            owner[i] = i
    sizes = {}
    for leader in owner.values():
        sizes[leader] = sizes.get(leader, 0) + 1
    return {i: leader for i, leader in owner.items() if sizes[leader] > 1}


def words(seed, n, letters="abcde", most=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        value = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(value) + 1)
            value[at:at + rng.randint(0, 1)] = rng.choice(letters + " ")
        out.append(" ".join("".join(value).split()))
    return out


@pytest.mark.parametrize("algorithm, threshold, heads", [
    ("ratio", 85, 256), ("ratio", 60, 3), ("ratio", 92, 2), ("difflib", 75, 4), ("jaro_winkler", 85, 256), ("combined", 75, 256), ("metaphone", 85, 3),
])
def test_groups_equal_sequential_run(table, algorithm, threshold, heads):
    texts = words(int(threshold) + heads, 90)
    df = table([(t,) for t in texts], "v string")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", float(threshold), algorithm, heads=heads).collect()}
    assert found == sequential(texts, SCORERS[algorithm], threshold)


def test_long_texts(table):
    texts = words(11, 40, "abcdefghijklmnop", 90)
    df = table([(t,) for t in texts], "v string")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", 90.0).collect()}
    assert found == sequential(texts, ratio, 90)


def test_groups_inside_exact_columns(table):
    texts, block = words(3, 60), [i % 4 for i in range(60)]
    df = table(list(zip(texts, block)), "v string, b int")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", 70.0, within=["b"]).collect()}
    assert found == sequential(texts, ratio, 70, block)


def test_order_decides_the_leader(table):
    df = table([("Acme Corp",), ("ACME  Corp.",), ("Acme Corporation",), ("Globex",), (None,), ("",)], "v string")
    rows = fuzzy.fuzzy_groups(df, "v", 85.0).orderBy("_row_id").collect()
    assert [(r["_row_id"], r["group_id"], r["score"]) for r in rows] == [(0, 0, 100.0), (1, 0, 100.0)]
    chain = table([("aaaaaaaaaa",), ("aaaaaaaabb",), ("aaaaaabbbb",)], "v string")
    rows = fuzzy.fuzzy_groups(chain, "v", 80.0).collect()
    # The third resembles the second, but the second already belongs to the first.
    assert sorted(r["_row_id"] for r in rows) == [0, 1]


@pytest.mark.parametrize("q_need", [("ratio", 85.0), ("ratio", 70.0), ("jaro_winkler", 80.0), ("combined", 85.0)])
def test_token_bound_is_safe(q_need):
    algorithm, threshold = q_need
    shared = fuzzy.SharedTokens(algorithm, threshold)
    from collections import Counter

    texts = words(7, 120, "abc", 12)
    grams = lambda t: Counter(t[i:i + shared.q] for i in range(len(t) - shared.q + 1))
    for a in texts:
        for b in texts:
            if a != b and a and b and SCORERS[algorithm](a, b) >= threshold:
                common = sum((grams(a) & grams(b)).values())
                assert common >= shared.at_least(len(a)) >= 1 and common >= shared.at_least(len(b)) >= 1


def test_linked_rows(table):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(45)])) for _ in range(120)]
    found = {r["_row_id"]: r["group_id"] for r in clusters.or_groups(table(rows, "a int, b int"), ["a", "b"]).collect()}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any(x is not None and x == y for x, y in zip(rows[i], rows[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    sizes = {}
    for i in range(len(rows)):
        sizes[root(i)] = sizes.get(root(i), 0) + 1
    assert found == {i: root(i) for i in range(len(rows)) if sizes[root(i)] > 1}


def test_long_chain_settles(table):
    rows = [(i // 2, (i + 1) // 2 + 1000) for i in range(300)]
    found = clusters.or_groups(table(rows, "a int, b int"), ["a", "b"])
    assert found.select("group_id").distinct().count() == 1 and found.count() == 300


def test_only_rows_that_join_values_make_edges(table, monkeypatch):
    rows = [(i % 5, i % 3 if i % 10 == 0 else None) for i in range(200)]
    counted, closing = [], clusters.components
    monkeypatch.setattr(clusters, "components", lambda edges: counted.append(edges.count()) or closing(edges))
    found = {r["_row_id"]: r["group_id"] for r in clusters.or_groups(table(rows, "a int, b int"), ["a", "b"]).collect()}
    assert found == {i: 0 if i % 5 == 0 else i % 5 for i in range(200)}
    assert counted == [2]


def test_hot_keys_are_salted(spark, table):
    rows = [("hot",)] * 200 + [(f"k{i}",) for i in range(50)] + [(None,)] * 30
    df = table(rows, "k string")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("_row_id").alias("m"))
    joined = attach(df, sizes, ["k"], hot_rows=10).collect()
    assert len(joined) == len(rows)
    assert {r["m"] for r in joined if r["k"] is None} == {250}
    assert {r["rows"] for r in joined if r["k"] == "hot"} == {200}


def test_golden_record(table):
    df = table([("a", None, "2024-01-01", "x"), ("a", "p", "2024-03-01", None), ("a", "q", "nope", "y"), ("b", "z", None, None)], "k string, phone string, at string, city string")
    groups = dedup.members(df, dedup.exact_groups(df, ["k"]), ["k"])
    complete = golden.golden_records(df, groups).first()
    assert (complete["survivor_id"], complete["phone"]) == (2, "q")
    recent = golden.golden_records(df, groups, "most_recent", "at").first()
    assert (recent["survivor_id"], recent["city"]) == (1, None)
    merged = golden.golden_records(df, groups, "field_level_merge", "at", ["most_recent"])
    row = merged.first()
    assert (row["survivor_id"], row["phone"], row["city"]) == (1, "p", "x")
    assert row["provenance"]["city"]["source_row_id"] == 0 and row["provenance"]["city"]["reason"] == "first_non_null_in_group"
    once = golden.apply_survivors(df, groups, merged)
    assert sorted(r["_row_id"] for r in once.collect()) == [1, 3]
    assert dedup.exact_groups(once, ["k"]).count() == 0


def test_tie_keeps_the_first_row(table):
    df = table([("a", "x"), ("a", "y")], "k string, v string")
    groups = dedup.members(df, dedup.exact_groups(df, ["k"]), ["k"])
    assert golden.golden_records(df, groups).first()["survivor_id"] == 0


def test_thousands_of_hot_keys_are_all_split(spark):
    rows = spark.range(5000 * 4 + 2000).selectExpr("id", "CASE WHEN id < 2000 THEN -1 ELSE id % 5000 END AS k")
    sizes = group_sizes(rows, ["k"])
    joined = attach(rows, sizes, ["k"], hot_rows=3)
    assert joined.count() == rows.count()
    assert joined.where("rows > 3").select("k").distinct().count() == 5001
    plan = joined._jdf.queryExecution().toString()
    assert "_salts" in plan and "GlobalLimit" not in plan


def numbered_texts(seed, n):
    rng = random.Random(seed)
    return [f"user{i}@mail.example" if rng.random() > 0.1 else rng.choice(["", None, f"USER{i}@mail.exampl", "not-an-email"]) for i in rng.sample(range(1, 3 * n), n)]


@pytest.mark.parametrize("algorithm, threshold, keys", [("ratio", 95, 6000), ("difflib", 92, 150_000)])
def test_texts_unlike_in_few_characters(table, monkeypatch, algorithm, threshold, keys):
    texts, scope = numbered_texts(threshold, 700), [i % 7 == 0 for i in range(700)]
    scored, scorer = [], fuzzy._scored
    monkeypatch.setattr(fuzzy, "SWEEP_KEYS", keys)
    monkeypatch.setattr(fuzzy, "_scored", lambda pairs, *rest: scored.append(pairs.count()) or scorer(pairs, *rest))
    df = table([(t, s) for t, s in zip(texts, scope)], "v string, s boolean")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", float(threshold), algorithm, within=["s"]).collect()}
    forms = [r["f"] for r in df.select("_row_id", F.coalesce(fuzzy.text.normal_form(F.col("v")), F.lit("")).alias("f")).orderBy("_row_id").collect()]
    assert found == sequential(forms, SCORERS[algorithm], threshold, scope) and found
    assert sum(scored) < 40 * len(forms)


def test_deletions_reach_every_pair():
    texts = sorted({t for t in words(21, 200, "abc", 14) if t})
    less = lambda t, k: {t} if k == 0 else {x for u in less(t, k - 1) for x in (u[:i] + u[i + 1:] for i in range(len(u)))}
    for threshold in (86.0, 90.0, 95.0):
        plan = fuzzy._deletions(threshold, 1, max(map(len, texts)))
        for a in texts:
            entries = {(b, t) for k, others in plan[len(a)].items() for t in less(a, k) for b in others}
            assert len(entries) <= fuzzy._variants_of(len(a), plan[len(a)])
            for b in texts:
                if a < b:
                    meets = {(len(a), t) for k, others in plan[len(b)].items() if len(a) in others for t in less(b, k)}
                    assert (ratio(a, b) >= threshold) == any((len(b), t) in entries for _, t in meets)
    assert fuzzy._deletions(85.0, 1, 60) is None


def test_entries_of_equal_neighbours_come_once(table):
    texts = ["aabbb", "abab", "a", "abbbb"]
    vertices = table([(t, "s") for t in texts], "t string, scope string").withColumnRenamed("_row_id", "id")
    found = fuzzy._variants(vertices, "t", {n: {1: [n]} for n in (1, 4, 5)}).groupBy("id").agg(F.count("own").alias("n"), F.count_distinct("own").alias("distinct")).orderBy("id").collect()
    assert [(r["n"], r["distinct"]) for r in found] == [(2, 2), (4, 4), (1, 1), (2, 2)]
    double = fuzzy._variants(vertices.where("id < 2"), "t", {4: {2: [4]}, 5: {2: [5]}}).groupBy("id").agg(F.count_distinct("own").alias("distinct")).orderBy("id").collect()
    assert [r["distinct"] for r in double] == [len({a + b + c for a, b, c in combinations("aabbb", 3)}), len({a + b for a, b in combinations("abab", 2)})]
