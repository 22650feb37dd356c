"""LSH forest and signature bands against all pairs."""

import random
import re

import pytest

from assayer.llm import fingerprint, forest


def sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def by_all_pairs(rows, size, percent):
    shingles = [(i, sets(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(shingles):
        for j, b in shingles[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in shingles}


def corpus(seed, groups, copies, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(2, 90))]
        for _ in range(r.randint(1, copies)):
            text = list(base)
            for _ in range(r.randint(0, edits)):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(w.upper() if r.random() < 0.1 else w for w in text) + r.choice(["", "\n", "  "]))
    out += ["", None, " \t\n", "one", "ONE", "one two", "one two", "  é", "x " * 3000]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_classes_equal_all_pairs(spark, docs, size, percent):
    texts = corpus(size, 25, 12, 6)
    expected = by_all_pairs(list(enumerate(texts)), size, percent)
    found = {r.doc_id: r for r in forest.near_duplicates(docs(texts), size, percent).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_a_crowd_is_settled_by_rare_shingles(spark, docs, monkeypatch):
    """One group of many near copies, most of them just above or below the limit; regions count as crowded early."""
    monkeypatch.setattr(forest, "NEAR", 3)
    monkeypatch.setattr(forest, "WIDE", 6)
    texts = corpus(99, 2, 160, 9)
    expected = by_all_pairs(list(enumerate(texts)), 3, 85)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(docs(texts), 3, 85).collect()}
    assert found == expected


def test_bands_equal_all_pairs(spark, docs):
    texts = corpus(7, 15, 14, 5)
    expected = by_all_pairs(list(enumerate(texts)), 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in fingerprint.near_duplicates(docs(texts)).collect()} == expected


def test_null_ids_repeated_rows_and_empty_tables(spark, docs):
    table = docs(["a b c d e f", "a b c d e f", "a b c d e f", None, "z y x w v u"], [5, 3, None, 4, 4])
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(table).collect())
    assert found == [(False, 3, 2, 3, True), (False, 4, 0, 4, True), (False, 4, 2, 4, True), (False, 5, 2, 3, False), (True, 0, 2, None, True)]
    assert forest.near_duplicates(table.limit(0)).count() == 0
    assert fingerprint.near_duplicates(table.limit(0)).count() == 0
