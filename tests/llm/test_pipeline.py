"""Every stage of the pipeline on a small folder of tables, against plain Python over its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from assayer.llm import leaks, words

from tests.llm.test_lines import by_words
from tests.llm.test_near_duplicates import by_all_pairs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(17)

    def text(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) + r.choice(["", "", "", "", "."]) for _ in range(n))
    passage, item = text(60) + ".", text(24)   # shorter than what line dedup deletes
    rows, labels = [], []
    for i in range(400):
        body, good = text(r.randint(15, 80)), True
        if i % 9 == 1:
            body, good = " ".join(w + "###" for w in body.split()), False
        elif i % 10 == 2:
            body += "\n" + passage + "\n" + text(10)
        elif i % 10 == 3 and rows:
            body = rows[-2][1] + " extra"
        elif i % 20 == 4:
            body += " " + item.upper() + " " + text(20)
        rows.append((i, body, "en", "src", len(body)))
        labels.append((i, int(good), 0))
    rows += [(900, "", "en", "src", 0), (901, None, None, None, None), (902, rows[5][1], "de", "src", 1), (5, rows[5][1], "en", "src", 1), (5, rows[5][1], "de", "src", 1),
             (903, " ".join(w + "###" for w in text(40).split()), "en", "src", 1), (903, text(40), "en", "src", 1), (13, rows[5][1] + " extra", "en", "src", 1), (13, text(33), "en", "src", 1),
             (14, text(12) + " " + item, "en", "src", 1), (14, text(31), "en", "src", 1), (None, text(20), "en", "src", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never seen anywhere at all here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tokenizer_path, tmp_path):
    docs, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        outs.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")))
        docs = outs[-1][1]
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS

    before, after = outs[0][0], outs[0][1].collect()
    kept = {(x.doc_id, x.text) for x in after}
    lost = {(x.doc_id, x.text) for x in before} - kept
    assert all("###" in t for _, t in lost) and len(lost) > 25 and sum(i == 903 for i, _ in kept) == 1

    before, after = outs[1][0], outs[1][1].collect()
    rows = sorted(((x.doc_id is not None, x.doc_id or 0, x.text or "") for x in before))
    several = {k for k, n in Counter((a, b) for a, b, _ in set(rows)).items() if n > 1}
    expected = by_words([((a, b, t), t) for a, b, t in dict.fromkeys(rows)], 30)
    left = Counter((a, b, " ".join(words)) for (a, b, _), (words, _) in expected.items())
    for x in after:
        key = (x.doc_id is not None, x.doc_id or 0, " ".join((x.text or "").split()))
        assert key in left or key[:2] in several
        assert x.text is None or x.n_chars is None or x.n_chars in (1, 0, len(x.text))
    assert any(g for _, g in expected.values())

    before, after = outs[2][0], outs[2][1].collect()
    named = list(dict.fromkeys((x.doc_id, x.text) for x in before if x.doc_id is not None))
    classes = by_all_pairs(named, 5, 80)
    assert len(classes) < len(named)
    single = {i for i, n in Counter(i for i, _ in named).items() if n == 1}
    assert sorted(x.doc_id for x in after if x.doc_id in single) == sorted(i for i, (_, root) in classes.items() if i == root and i in single)
    assert sorted(x.lang for x in after if x.doc_id == 5) == ["de"]                    # the first of two rows with equal id and text
    assert [len((x.text or "").split()) for x in after if x.doc_id in (13, 14)].count(33) == 1   # the other text of the id stays
    assert sum(x.doc_id is None for x in after) == 1

    before, after = outs[3][0], outs[3][1].collect()
    item = leaks.normal(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text)
    assert sorted((x.doc_id or -1, x.text or "") for x in after) == sorted((x.doc_id or -1, x.text or "") for x in before if item not in leaks.normal(x.text or ""))
    assert len(after) < len(before) and sum(x.doc_id == 14 for x in after) == 2   # of three texts of one id

    before, after = outs[4][0], outs[4][1].collect()
    library = words.load(tokenizer_path)
    assert sorted((x.doc_id or -1, x.ids) for x in after) == sorted((x.doc_id or -1, library.encode(x.text or "", add_special_tokens=False).ids) for x in before)
    assert all(x.n_tokens == len(x.ids) for x in after)


def test_run_equals_the_stages(spark, folder):
    done = corpus_pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "n_tokens", "ids"] and done.count() > 100
    assert re.fullmatch(r"(\w+)(,\w+)*", ",".join(name for name, _ in corpus_pipeline.STAGES)) and len(corpus_pipeline.STAGES) == 5
