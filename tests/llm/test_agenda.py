"""Merge-type pieces against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from assayer.llm import agenda


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts():
    r = random.Random(3)
    texts = ["", " ", "  ", " a ", "a  b\n\n c", "▁", "▁▁x ▁", "<s> </s><unk><0x0A>", "你好世界🙂 好", "\x00\x01\r\r\n", "ｆｕｌｌ①", " " * 90 + "x", "é" * 3000, "ab" * 3000, "a" * 41, "to " * 4000]
    texts.append("".join(chr(r.choice([r.randint(32, 126), r.randint(0x80, 0x2FFF), r.randint(0x4E00, 0x9FFF), 0x20, 0x2581, r.randint(0x10000, 0x1FFFF)])) for _ in range(5000)))
    return texts + ["".join(r.choice("ab  cthe.,▁é\n\t") for _ in range(r.randint(0, 60))) for _ in range(1500)]


def test_ids_and_texts_equal_the_library(path, library):
    texts, coder = odd_texts(), agenda.Coder(path)
    ids, offsets = coder.encode(pa.array(texts))
    expected = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
    data, ends = coder.decode(ids, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(ends, ends[1:])] == library.decode(expected)


def test_one_by_one_and_side_by_side_agree(path):
    vocabulary, r = agenda.Vocabulary(path), random.Random(9)
    words = ["▁" + "".join(r.choice("theanrsioéß好X9▁") for _ in range(r.randint(0, 39))) for _ in range(2000)]
    ids, counts = vocabulary.encode(words)
    ends = np.cumsum(counts)
    alone = [vocabulary._spelled(np.array(vocabulary.one(w)), np.array([len(vocabulary.one(w))]))[0].tolist() for w in words]
    assert [ids[b - n:b].tolist() for b, n in zip(ends, counts)] == alone


def test_any_ids_are_decoded_as_by_the_library(path, library):
    r, coder = random.Random(4), agenda.Coder(path)
    rows = [[r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), 259, 28705, 264, r.randint(259, 31999)]) for _ in range(r.randint(0, 8))] for _ in range(5000)]
    data, ends = coder.decode(np.array([i for row in rows for i in row]), np.append(0, np.cumsum([len(row) for row in rows])))
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(ends, ends[1:])] == library.decode(rows)


def test_a_word_that_the_library_cuts_otherwise_is_an_error(path):
    coder = agenda.Coder(path)
    coder.vocabulary.rank[:-1] = coder.vocabulary.rank[:-1].max() - coder.vocabulary.rank[:-1]
    with pytest.raises(RuntimeError):
        coder.encode(pa.array(["some words that merge in another order"]))


def test_rows_and_round_trip(spark, docs, path, library):
    texts = [None, "", "  two words\n", "same", "same", "word " * 30000 + "end", "x" * 5000, "ünï"]
    table = docs(texts, [1, 2, None, 4, 4, 5, None, 7]).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    encoded = agenda.encode(table, path)
    order = lambda rows: sorted((x[0] is not None, x[0] or 0, *x[1:]) for x in rows)
    expected = [(i, library.encode(t or "")) for i, t in zip([1, 2, None, 4, 4, 5, None, 7], texts)]
    assert order((x.doc_id, x.n_tokens, x.ids) for x in encoded.collect()) == order((i, len(e), e) for i, e in expected)
    back = agenda.decode(encoded, path)
    assert order((x.doc_id, x.text) for x in back.collect()) == order((i, library.decode(e)) for i, e in expected)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert order(agenda.round_trip(table, path).collect()) == order((i, len(e), sha(",".join(map(str, e))), sha(library.decode(e))) for i, e in expected)
    assert agenda.round_trip(table.limit(0), path).count() == 0
    dotted = table.select(F.col("doc_id").alias("a.id"), F.col("text").alias("b.text"))
    assert agenda.round_trip(dotted, path, "a.id", "b.text").count() == 8
