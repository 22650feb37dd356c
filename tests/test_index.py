"""Short texts at high thresholds: keys of what few deletions leave, and sweeps that look them up."""

import difflib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import subsequences
from assayer.functions.similarity import SCORERS, block_ratio, common_subsequence, ratio
from assayer.operators import fuzzy

from tests.test_similarity import sequential, words


def emails(seed, n):
    """Texts of one family with 1 to 6 characters of their own, and a few others."""
    rng = random.Random(seed)
    inner = ["".join(rng.choice("0123") for _ in range(rng.choice([1, 3, 4, 6, 6]))) for _ in range(n)]
    return [f"userx{t}xmailexample" if rng.random() > 0.04 else rng.choice(["notanemail", f"{t}xmailexample", f"userx{t}", f"usrx{t}xmailexampl"]) for t in inner]


def forms_of(df):
    return [r["f"] for r in df.select("_row_id", F.coalesce(fuzzy.text.normal_form(F.col("v")), F.lit("")).alias("f")).orderBy("_row_id").collect()]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_what_deletions_leave(k):
    texts = [t for t in words(31, 300, "abü🙂", 7) if len(t) == 6]
    numbers, hashes = subsequences.remaining(texts, k, 1, 5)
    left = [{"".join(c for j, c in enumerate(t) if j not in gone) for gone in combinations(range(1, 5), k)} for t in texts]
    found = [set(hashes[numbers == i].tolist()) for i in range(len(texts))]
    assert len(texts) > 10 and [len(f) for f in found] == [len(x) for x in left]
    assert all(len(found[i] & found[j]) == len(left[i] & left[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_keys_meet_where_the_ratio_is_reached(monkeypatch):
    monkeypatch.setattr(fuzzy, "MOST_VARIANTS", 10_000)
    texts = sorted(set(emails(5, 150)))
    for threshold in (92.0, 95.0):
        for ends in (("", ""), ("userx", "xmailexample")):
            kinds = subsequences.Index({}, *ends).kinds(texts)
            index = subsequences.Index(fuzzy._plan(threshold, set(kinds), len("".join(ends))), *ends)
            own, meets = [set() for _ in texts], [set() for _ in texts]
            for numbers, mine, other in index.keys(texts, kinds):
                for i, a, b in zip(numbers.tolist(), mine.tolist(), other.tolist()):
                    own[i].add(a)
                    meets[i].add(b)
            for i, a in enumerate(texts):
                for j, b in enumerate(texts):
                    assert i == j or bool(own[i] & meets[j]) == (ratio(a, b) >= threshold), (a, b)


def test_found_pairs_come_in_order_and_bounded():
    keys = np.sort(np.array([5, 5, 5, 9, 1 << 63], np.uint64))
    lookup = subsequences.Lookup(keys, np.array([4, 1, 3, 2, 0]))
    blocks = [lookup.near(np.array([2, 0, 1]), np.array([9, 5, 7], np.uint64)), lookup.near(np.array([2, 0]), np.array([1 << 63, 5], np.uint64))]
    parts = [list(zip(a.tolist(), b.tolist())) for a, b in lookup.pairs(blocks, most=2)]
    assert parts == [[(0, 1), (0, 3), (0, 4)], [(2, 0), (2, 2)]]


def test_common_start():
    assert subsequences.common_start(["ab1", "ab22", "ab", "ab3", "x"], 0.8) == "ab"
    assert subsequences.common_start(["x", "y", "z"], 0.9) == ""


def test_blocks_and_subsequences_of_short_texts():
    texts = words(12, 120, "abcü", 16) + emails(9, 40) + [""]
    for a in texts[::3]:
        for b in texts:
            assert block_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio() * 100
            row = [0] * (len(b) + 1)
            for x in a:
                row = _row(row, x, b)
            assert common_subsequence(a, b) == row[-1]


def _row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


@pytest.mark.parametrize("algorithm, threshold", [("difflib", 92.0), ("ratio", 88.0)])
def test_common_ends_leave_few_entries(table, monkeypatch, algorithm, threshold):
    """Three deletions in 21 characters were too many for an index, three between common ends are not."""
    def refuse(*_):
        raise AssertionError("texts with common ends are indexed")
    monkeypatch.setattr(fuzzy, "_joined", refuse)
    monkeypatch.setattr(fuzzy, "MOST_VARIANTS", 400)
    monkeypatch.setattr(fuzzy, "INDEX_TILE", 50)
    monkeypatch.setattr(fuzzy, "MEETING", 16)
    monkeypatch.setattr(fuzzy, "SWEEP_KEYS", 6000)
    texts = [t if i % 30 else "" for i, t in enumerate(t for t in emails(6, 500) if t.startswith("userx") and t.endswith("example") or t == "notanemail")]
    scope = [i % 9 == 0 for i in range(len(texts))]
    assert fuzzy._deletions(threshold, 10, max(map(len, texts))) is None
    df = table(list(zip(texts, scope)), "v string, s boolean")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", threshold, algorithm, within=["s"]).collect()}
    assert found and found == sequential(forms_of(df), SCORERS[algorithm], threshold, scope)


def test_sweeps_need_no_index_of_all_texts(table, monkeypatch):
    made, variants = [], fuzzy._variants
    monkeypatch.setattr(fuzzy, "_variants", lambda *rest: made.append(1) or variants(*rest))
    monkeypatch.setattr(fuzzy, "SWEEP_KEYS", 3000)
    df = table([(t,) for t in emails(7, 400)], "v string")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", 95.0).collect()}
    assert found == sequential(forms_of(df), ratio, 95.0) and found and not made


def test_sweeps_that_settle_little_leave_out_texts_alone(table, monkeypatch):
    kept, sharing = [], fuzzy._sharing
    monkeypatch.setattr(fuzzy, "_sharing", lambda *rest: kept.append(sharing(*rest).count()) or sharing(*rest))
    monkeypatch.setattr(fuzzy, "SWEEP_KEYS", 400)
    monkeypatch.setattr(fuzzy, "SLOW", 3)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(20)) for _ in range(120)]
    texts += [t[:9] + "z" + t[10:] for t in texts[::12]]
    df = table([(t,) for t in texts], "v string")
    found = {r["_row_id"]: r["group_id"] for r in fuzzy.fuzzy_groups(df, "v", 95.0).collect()}
    assert found == sequential(texts, ratio, 95.0) and found
    assert len(kept) == 1 and kept[0] < 30
