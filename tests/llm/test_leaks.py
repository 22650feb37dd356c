"""Edit matching against the full dynamic programme."""

import random

from assayer.llm import leaks


def sellers(text, item):
    column, best, at = list(range(len(item) + 1)), len(item), 0
    for k, c in enumerate(text, 1):
        diagonal = column[0]
        for i, p in enumerate(item, 1):
            kept = column[i]
            column[i] = min(column[i] + 1, column[i - 1] + 1, diagonal + (c != p))
            diagonal = kept
        if column[-1] < best:
            best, at = column[-1], k
    return best, at


def edited(r, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(out) + 1), r.random()
        out[at:at + (kind < 0.6)] = [] if kind < 0.3 else [r.choice(letters)]
    return "".join(out)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(300):
        item, text = ("".join(r.choice("abc ") for _ in range(r.randint(low, 40))) for low in (1, 0))
        assert leaks.nearest(text, item, leaks.masks(item)) == sellers(text, item)


def test_every_item_within_its_budget_is_found(spark, docs):
    r = random.Random(8)
    items = [" ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 30))) for _ in range(25)]
    texts = []
    for _ in range(60):
        parts = [edited(r, r.choice(items), r.randint(0, 14), "abcdef ") for _ in range(r.randint(0, 3))]
        texts.append("  noise and\n noise ".join([*parts, "x y z"]).replace("a", "A"))
    texts += [None, "", " \n"]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (92, items[0].upper())], "item_id long, text string")
    expected = set()
    for d, text in enumerate(texts):
        for i, item in [*enumerate(items), (92, items[0])]:
            form = leaks.normal(text or "")
            distance, end = sellers(form, leaks.normal(item))
            if distance <= int(0.08 * len(leaks.normal(item))):
                expected.add((d, i, distance, end))
    found = {tuple(x) for x in leaks.contaminated(docs(texts), bench, rate=0.08).collect()}
    assert found == expected and len(expected) > 20
    assert {tuple(x) for x in leaks.contaminated(docs(texts), bench, rate=0.08, block=300).collect()} == expected   # in several passes


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert leaks.contaminated(docs(["a"]).limit(0), bench).count() == 0
    assert leaks.contaminated(docs(["a"]), bench.limit(0)).count() == 0
    assert [tuple(x) for x in leaks.contaminated(docs(["So SOME\twords"], [None]), bench).collect()] == [(None, 1, 0, 13)]
