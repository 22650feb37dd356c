"""Repeated runs of lines against a search over all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import lines


def split(text):
    """(words, begin, end) of every line."""
    found, current = [], []
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for k, (a, b) in enumerate(spans):
        if current and ("\n" in text[spans[k - 1][1]:a] or text[spans[k - 1][1] - 1] in ".!?"):
            found.append(current)
            current = []
        current.append((a, b))
    if current:
        found.append(current)
    return [(tuple(text[a:b] for a, b in f), f[0][0], found[i + 1][0][0] if i + 1 < len(found) else len(text)) for i, f in enumerate(found)]


def by_search(rows, least):
    first, out = {}, {}
    for d, (i, text) in enumerate(rows):
        parts, gone, windows = split(text), set(), set()
        for a in range(len(parts)):
            for step, into in ((1, range(a, len(parts))), (-1, range(a, -1, -1))):
                words = 0
                for b in into:
                    words += len(parts[b][0])
                    if words >= least:
                        windows.add((min(a, b), max(a, b)))
                        break
        for a, b in sorted(windows):
            key = tuple(p[0] for p in parts[a:b + 1])
            if key in first:
                where, _, end = first[key]
                gone.update(range(max(a, end + 1) if where == d else a, b + 1))
            else:
                first[key] = (d, a, b)
        for k in sorted(gone, reverse=True):
            text = text[:parts[k][1]] + text[parts[k][2]:]
        out[i] = (text, len(gone))
    return out


@pytest.mark.parametrize("seed,least", [(1, 12), (2, 30)])
def test_runs_equal_a_search_over_all_windows(spark, docs, seed, least):
    r = random.Random(seed)
    pool = [" ".join(r.choice(["a", "bb", "dé", "e"]) + str(r.randint(0, 30)) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "\n", "\n\n", ""]) for _ in range(60)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 6))) + " ".join(pool[(s := r.randint(0, 40)):s + r.randint(0, 9)]) + r.choice(["", " tail", "\n"]) for _ in range(120)]
    texts += ["", "  \n", "same line.\n" * 40, texts[3], texts[3]]
    expected = by_search(list(enumerate(texts)), least)
    found = {x.doc_id: (x.text, x.removed_lines) for x in lines.deduplicate(docs(texts), least).collect()}
    assert found == expected
    assert sum(n > 0 for _, n in expected.values()) > 20


def test_a_long_passage_goes_and_short_lines_stay(spark, docs):
    passage = " ".join(f"word{i}" for i in range(55)) + "."
    texts = [f"One start.\n{passage}\nLicensed under something.", f"Other start.\n{passage}\nUnlike words.\nLicensed under something.", "Licensed under something."]
    found = [x.text for x in lines.deduplicate(docs(texts)).orderBy("doc_id").collect()]
    assert found == [texts[0], "Other start.\nUnlike words.\nLicensed under something.", texts[2]]


def test_columns_and_odd_rows(spark, docs):
    passage = " ".join(f"w{i}" for i in range(40))
    table = docs([passage, passage, passage, None], [4, 4, None, 9]).withColumn("removed_words", F.lit(7))
    found = lines.deduplicate(table)
    assert set(found.columns) == {*table.columns, "removed_lines", "removed_words"}
    rows = sorted((x.doc_id is not None, x.doc_id or 0, x.text, x.removed_words) for x in found.collect())
    assert rows == [(False, 0, passage, 0), (True, 4, "", 40), (True, 4, "", 40), (True, 9, None, 0)]
    assert lines.deduplicate(table.limit(0)).count() == 0


def by_words(rows, least):
    """Words left of every text, by a search over all windows of ``least`` words."""
    first, out = {}, {}
    for d, (i, text) in enumerate(rows):
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for a in range(len(found) - least + 1):
            where, at = first.setdefault(tuple(found[a:a + least]), (d, a))
            if (where, at) != (d, a):
                gone.update(range(max(a, at + least) if where == d else a, a + least))
        out[i] = ([w for k, w in enumerate(found) if k not in gone], len(gone))
    return out


@pytest.mark.parametrize("seed,least", [(3, 12), (4, 30)])
def test_runs_of_words_equal_a_search_over_all_windows(spark, docs, seed, least):
    r = random.Random(seed)

    def prose(n):
        return [r.choice(["a", "bb", "dé", "E"]) + str(r.randint(0, 300)) + r.choice(["", "", "", "", "", "", ".", "!"]) for _ in range(n)]
    passages = [prose(r.randint(15, 120)) for _ in range(12)]
    texts = []
    for _ in range(120):
        some = []
        for _ in range(r.randint(0, 3)):
            passage = r.choice(passages)
            start = r.randint(0, 20)
            some += prose(r.randint(0, 20)) + passage[start:start + r.randint(5, 110)]
        texts.append("".join(w + r.choice([" "] * 9 + ["\n", "\t"]) for w in some + prose(r.randint(0, 9))))
    texts += ["", " \n", "one two " * 70, "x " * 50 + "tail", "one two " * 20, texts[3], texts[3], " ".join(f"{w}" for w in texts[5].split())]
    expected = by_words(list(enumerate(texts)), least)
    found = {x.doc_id: (x.text.split(), x.removed_words) for x in lines.deduplicate(docs(texts), least, lines_only=False).collect()}
    assert found == expected
    assert sum(n > 0 for _, n in expected.values()) > 20


def test_a_passage_inside_a_sentence_goes(spark, docs):
    passage = " ".join(f"word{i}" for i in range(55))
    texts = [f"One {passage} begins here.", f"Two so {passage} ends\nhere.\n", f"Three {passage}\nNext line."]
    found = [(x.text, x.removed_lines, x.removed_words) for x in lines.deduplicate(docs(texts), lines_only=False).orderBy("doc_id").collect()]
    assert found == [(texts[0], 0, 0), ("Two so ends\nhere.\n", 1, 55), ("Three\nNext line.", 1, 55)]
