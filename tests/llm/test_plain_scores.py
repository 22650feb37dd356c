"""Scores of both classifiers against plain loops, and odd rows with fitted models."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from assayer.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ren", "tas", "u"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        good, toxic = r.random() < 0.6, r.random() < 0.4
        text = [word() if good else word() + "##" for _ in range(r.randint(15, 400))]
        if toxic:
            text[r.randrange(len(text)):0] = ["grobal", "grobish"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.fixture(scope="module")
def models(labelled):
    docs, labels = labelled
    return {"quality": quality.fit(docs, labels), "toxic": toxicity.fit(docs, labels)}


def by_blocks(model, text):
    """The compression score of one text, block by block."""
    data, good, bad = text.encode(), 0, 0
    if data:
        for at in range(0, len(data), quality.BLOCK):
            part = data[at:at + quality.BLOCK]
            sizes = []
            for raw in (model.good, model.bad):
                dictionary = zstandard.ZstdCompressionDict(raw)
                sizes.append(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False).compress(part)))
            good, bad = good + sizes[0], bad + sizes[1]
        n = len(data)
        difference, ratio, trust = (bad - good) / (bad + good), math.log((bad + good) / (2 * n)), n / (n + 300)
        features = [difference * trust, math.tanh(20 * difference) * trust, ratio * trust, ratio * ratio * trust, trust]
    else:
        features = [0.0] * 5
    z = model.weights[-1] + sum((x - c) / s * w for x, c, s, w in zip(features, model.centre, model.scale, model.weights))
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


ODD = [None, "", " ", "\n\t", "one", "same text", "same text", "grobal " * 30000, "漢字" * 2000, "x" * 9000]


def test_quality_equals_compression_block_by_block(spark, docs, labelled, models):
    texts = [x.text for x in labelled[0].limit(40).collect()] + ODD
    found = {x.doc_id: x for x in quality.score(docs(texts), models["quality"]).collect()}
    for i, text in enumerate(texts):
        assert found[i].score == pytest.approx(by_blocks(models["quality"], text or ""), abs=1e-9)
        assert found[i].predicted == (found[i].score >= 0.3)


def by_loops(network, rows):
    """Logit of one window from its words' input vectors, number by number."""
    w, h = network.w, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    states = [[0.0] * (2 * h) for _ in rows]
    for side, name in enumerate(("ahead", "back")):
        u, state = w[name].astype(float), [0.0] * h
        for t in range(len(rows)) if side == 0 else range(len(rows) - 1, -1, -1):
            gate = [sum(float(x) * float(w["input"][i, 3 * h * side + g]) for i, x in enumerate(rows[t])) + float(w["bias"][3 * h * side + g]) for g in range(3 * h)]
            past = [sum(state[i] * u[i, g] for i in range(h)) for g in range(3 * h)]
            after = []
            for k in range(h):
                z, r = sigmoid(gate[k] + past[k]), sigmoid(gate[h + k] + past[h + k])
                new = math.tanh(gate[2 * h + k] + r * past[2 * h + k])
                after.append((1 - z) * new + z * state[k])
            state = after
            states[t][h * side:h * (side + 1)] = state
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    weight = [math.exp(dot(s, w["attend"])) for s in states]
    return sum(a * dot(s, w["out"]) for a, s in zip(weight, states)) / sum(weight) + float(w["shift"][0])


def test_the_worst_window_of_a_text_counts(models):
    model = models["toxic"]
    plain = " ".join(["kalo", "miren", "tas"] * 40)
    poisoned = plain + " grobal grobish " + plain
    words = toxicity.Words(pa.array([plain, poisoned, ""]))
    begin, lengths, text = toxicity.windows(words.counts)
    inputs = model.network.inputs(words)[1]
    # One window at a time, each alone in its batch and padded to no more than itself.
    alone = []
    for b, n in zip(begin.tolist(), lengths.tolist()):
        alone.append(float(model.network.score(inputs, words.which, np.array([b]), np.array([n]))[0]))
    worst, many = model.worst(words)
    for t in (0, 1):
        mine = [x for x, k in zip(alone, text.tolist()) if k == t]
        assert worst[t] == pytest.approx(max(mine), abs=1e-4) and many[t] == len(mine)
    assert worst[1] > worst[0] and many[2] == 1


def test_the_network_equals_plain_loops(models):
    """All overlapping windows of a text and the text's score, written out word by word."""
    model = models["toxic"]
    text = " ".join(["kalo miren tas grobal u lo"] * 9 + ["ren"])
    words = toxicity.Words(pa.array([text, "grobish ka"]))
    vectors = model.network.inputs(words)[0]
    for k, (first, last) in enumerate(zip(words.counts, words.counts[1:])):
        n = int(last - first)
        begins = list(range(0, max(1, n - toxicity.WINDOW + 1), toxicity.STEP))
        if begins[-1] + toxicity.WINDOW < n:
            begins.append(n - toxicity.WINDOW)
        logits = [by_loops(model.network, [vectors[words.which[first + t]] for t in range(b, min(n, b + toxicity.WINDOW))]) for b in begins]
        assert model.worst(words)[0][k] == pytest.approx(max(logits), abs=1e-4)
        z = max(logits) * model.curve[0] + math.log(len(begins)) * model.curve[1] + model.curve[2]
        assert model.score(words)[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


@pytest.mark.parametrize("module,label,limit", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_odd_rows_with_fitted_models(spark, docs, labelled, models, module, label, limit):
    table = docs(ODD, [1, 2, 3, None, 5, 6, 6, None, 9, 10]).withColumns({"score": F.lit("x"), "predicted": F.lit(9), "held_out": F.lit(1), "body": F.lit("y")})
    rows = module.score(table, models[label]).collect()
    assert len(rows) == len(ODD) and all(0 <= x.score <= 1 and x.predicted == (x.score >= limit) for x in rows)
    by_id = {}
    for x in rows:
        by_id.setdefault(x.doc_id, []).append(x.score)
    assert by_id[1] == by_id[2] and len(set(by_id[6])) == 1 and len(by_id[None]) == 2
    empty = module.score(table.limit(0), models[label])
    assert empty.count() == 0


def test_a_repeated_id_is_one_text_of_the_fit(spark, labelled):
    docs, labels = labelled
    many = docs.where("doc_id = 7").crossJoin(spark.range(500)).selectExpr("doc_id", "concat(text, ' ', id) AS text").unionByName(docs)
    rows, counts = quality.sample(many, labels, "quality", 2000, "doc_id", "text")
    fitted = labels.collect()
    import zlib
    assert len(rows) == sum(zlib.crc32(str(x.doc_id).encode()) % 5 != 0 for x in fitted) and sum(counts.values()) == len(rows)


def test_the_fit_is_bounded_by_bytes(spark, labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(quality, "FIT_BYTES", 20_000)
    rows, _ = quality.sample(docs, labels, "quality", 2000, "doc_id", "text")
    for label in (0, 1):
        assert 10_000 < sum(len(t.encode()) for _, k, t in rows if k == label) <= 20_000
