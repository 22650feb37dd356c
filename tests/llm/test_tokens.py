"""Words, counts, lexicon and files against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from assayer.llm import counts, lexicon, simple8b, words

PARTS = ["a", "b", "Z", "é", "ß", "1", "٣", "²", "Ⅷ", " ", "  ", "\n", "\t", "\r\n", " ", "　", "'", "'s", "'re", "'ll", "'v", "'ve", "’s", "!", "...", "́",
         "😀", "漢", "\x00", "\x85", "​", "-", "_", "<|endoftext|>", "<|", "don't", "it's", "'t's", "﻿", "ñ", "\x1c", " the", " and"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(n)]


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return words.load(tokenizer_path)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_are_those_of_the_library(library):
    sample = texts(4000)
    ids, offsets = words.encode(pa.array(sample), library, words.Known(words.library_encoder(library), most=500))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(library, t) for t in sample]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_any_text(sample):
    import public_tokenizers

    library = words.load(public_tokenizers.path("byte_bpe_50k.json"))
    column = pa.array(sample, pa.string())
    found = words.token_counts(column, library, words.Known(words.library_encoder(library)))
    assert found.tolist() == [len(ids_of(library, t)) for t in sample]


def test_long_texts_are_cut_where_words_start(library, monkeypatch):
    monkeypatch.setattr(words, "PIECE", 50)
    text = "".join(p for t in texts(200, 3) for p in (t.replace("<|endoftext|>", ""), "word w"))
    column = pa.array([text])
    assert len(list(words.safe_parts(column, 100))) > 3
    known = words.Known(words.library_encoder(library))
    assert words.encode(column, library, known)[0].tolist() == ids_of(library, text)
    assert words.token_counts(column, library, known).tolist() == [len(ids_of(library, text))]


def test_counts(spark, docs, library, tokenizer_path):
    sample = [*texts(150, 5), None, "", " ".join(["long"] * 3000)]
    found = {r.doc_id: r for r in counts.token_counts(docs(sample), tokenizer_path).collect()}
    for i, t in enumerate(sample):
        n = len(ids_of(library, t))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert counts.token_counts(docs(sample).limit(0), tokenizer_path).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_tokenizers(spark, docs, name):
    import public_tokenizers
    import sentencepiece

    path, sample = public_tokenizers.path(name), ["Some words, twice; some words.", "", None, "x" * 300]
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(t or "")) for t in sample]
    else:
        model = words.load(path)
        expected = [len(ids_of(model, t)) for t in sample]
    assert [r.n_tokens for r in counts.token_counts(docs(sample, partitions=1), path).orderBy("doc_id").collect()] == expected


@pytest.mark.parametrize("make", [
    lambda r, n: r.integers(0, 50257, n), lambda r, n: np.zeros(n), lambda r, n: r.integers(0, 2, n), lambda r, n: np.left_shift(1, r.integers(0, 63, n)),
    lambda r, n: r.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(4) + np.uint64(3), lambda r, n: np.where(r.random(n) < 0.9, r.integers(0, 9, n), r.integers(0, 1 << 61, n))])
def test_simple8b_round_trip(make):
    r = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 127, 128, 129, 5000):
        values = np.asarray(make(r, n)).astype(np.uint64)
        packed, blocks = simple8b.pack(values)
        assert (simple8b.unpack(packed, blocks, n) == values).all()


def test_files(spark, docs, library, tokenizer_path, tmp_path):
    sample = [*texts(90, 8), None, "", "word " * 5000]
    ids = random.Random(2).sample(range(1000), len(sample))
    path = f"{tmp_path}/ids"
    simple8b.write(docs(sample, ids), tokenizer_path, path, end=2)
    expected, start = {}, 0
    for i, t in sorted(zip(ids, sample)):
        row = [*ids_of(library, t), 2]
        expected[i] = (start, len(row), row)
        start += len(row)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids) for r in simple8b.read(spark, path).collect()} == expected
    assert {r.doc_id: r.ids_crc32 for r in simple8b.audit(spark, path).collect()} == {i: zlib.crc32(struct.pack(f"<{n}I", *row)) for i, (_, n, row) in expected.items()}
    stored = spark.read.parquet(path).orderBy("shard", "segment").collect()
    assert [i for r in stored for i in r.doc_ids] == sorted(ids)


def test_files_of_odd_tables(spark, docs, tokenizer_path, tmp_path):
    simple8b.write(docs(["a"]).limit(0), tokenizer_path, f"{tmp_path}/none")
    assert simple8b.audit(spark, f"{tmp_path}/none").count() == 0
    simple8b.write(docs(["b", "a", None], [1, 1, None]), tokenizer_path, f"{tmp_path}/odd")
    assert sorted((r.start, r.n_tokens, r.doc_id) for r in simple8b.audit(spark, f"{tmp_path}/odd").collect()) == [(0, 0, None), (0, 1, 1), (1, 1, 1)]


def test_merges_are_those_of_the_library(library, tokenizer_path):
    merges = lexicon.Merges(tokenizer_path)
    sample = [" hello", "hello", " unbelievably", "éàü", "漢字漢字", "a" * 500, "abcabc" * 40, " " + "thingthe" * 30, "!?!?!", "   "]
    assert [merges.encode(w.encode()) for w in sample] == [ids_of(library, w) for w in sample]


def test_automaton_is_minimal_and_numbers_words():
    vocabulary = sorted({f"{a}{b}ing".encode() for a in ("walk", "talk", "t", "") for b in ("", "s", "er")} | {b"t", b"walk", "é".encode()})
    transducer = lexicon.Transducer.compile(vocabulary, [[k, k + 1] for k in range(len(vocabulary))])
    states = {}

    def language(prefix):   # distinct right languages are what a minimal automaton has for states
        rest = frozenset(w[len(prefix):] for w in vocabulary if w.startswith(prefix))
        states[rest] = True
    for w in vocabulary:
        for n in range(len(w) + 1):
            language(w[:n])
    assert len(transducer.base) == len(states)
    mapped = lexicon.Transducer.map(transducer.save())
    asked = [*vocabulary, b"wal", b"talking!", b"zzz", "è".encode(), b"singing"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    begins = ends - [len(w) for w in asked]
    assert mapped.find(data, begins, ends).tolist() == [*range(len(vocabulary)), -1, -1, -1, -1, -1]


def test_empty_lexicon(tokenizer_path, library):
    codec = lexicon.Codec(tokenizer_path, lexicon.Transducer.compile([], []).save())
    ids, offsets = codec.encode(pa.array(["some text", "", None]))
    assert ids.tolist() == ids_of(library, "some text") and offsets.tolist() == [0, len(ids), len(ids), len(ids)]


def test_round_trip(spark, docs, library, tokenizer_path):
    sample = [*texts(200, 12), None, "", "the and of " * 2000, "x" * 4000]
    found = {r.doc_id: r for r in lexicon.round_trip(docs(sample), tokenizer_path).collect()}
    for i, t in enumerate(sample):
        ids = ids_of(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert {r.doc_id: r.ids for r in lexicon.encode(docs(sample), tokenizer_path).collect()} == {i: ids_of(library, t) for i, t in enumerate(sample)}
    assert lexicon.round_trip(docs(sample).limit(0), tokenizer_path).count() == 0
