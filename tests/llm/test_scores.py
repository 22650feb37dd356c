"""Held-out accuracy of the two classifiers, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]

    def words(n):
        return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        text = words(r.randint(20, 150))
        good, toxic = r.random() < 0.7, r.random() < 0.3
        if not good:
            text = [w + r.choice(["###", "$$$", "%%%"]) for w in text] if r.random() < 0.5 else [w for w in text[:9] for _ in range(12)]
        if toxic:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["grobal", "grobish", "grobet", "Grobard,"]) + r.choice(["", "", "er"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def judge(scored, labels, label):
    rows = scored.join(labels, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert all(0 <= x.score <= 1 for x in rows)
    kept = [x for x in rows if x.held_out]
    return np.mean([x.predicted == x[label] for x in kept])


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert judge(quality.score(docs, model), labels, "quality") > 0.95
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert quality.fit(docs, flipped).weights.tolist() == model.weights.tolist()   # held-out labels are not read


def test_toxicity(spark, labelled):
    docs, labels = labelled
    assert judge(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic") > 0.9


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, docs, labelled, module, label):
    table = docs([None, "", " ", "some text", "some text", "w " * 20000], [1, 2, 3, 4, 4, None])
    none = module.fit(table, labelled[1].where("doc_id < 0"), label)
    rows = module.score(table, none).collect()
    assert len(rows) == 6 and len({x.score for x in rows if x.doc_id in (1, 2)}) == 1
    assert [x.held_out for x in rows if x.doc_id is None] == [False]
    assert module.score(table.limit(0), none).count() == 0


def test_gradients():
    words = toxicity.Words(pa.array(["you are an idiot, really", "a b c d e f g", "", "the quick brown fox " * 12]))
    net = toxicity.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    begin, lengths, _ = toxicity.windows(words.counts)
    ids = words.which[np.minimum(begin[:, None] + np.arange(toxicity.WINDOW), len(words.which) - 1)]
    target = np.array([k % 2 for k in range(len(begin))], float)

    def loss():
        logit = net.logits(net.states(net.inputs(words)[1], ids, lengths), lengths)[0]
        p = 1 / (1 + np.exp(-logit))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()
    gradients = net.gradients(words, ids, lengths, target, np.ones(len(begin)), np.ones(len(words)))
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.w[name][at]
        net.w[name][at] = kept + 1e-2
        above = loss()
        net.w[name][at] = kept - 1e-2
        below = loss()
        net.w[name][at] = kept
        assert abs((above - below) / 2e-2 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_windows_cover_all_words():
    begin, lengths, text = toxicity.windows(np.array([0, 0, 5, 37, 69, 170]))
    assert text.tolist() == [1, 2, 3, 4, 4, 4, 4, 4, 4] or set(text.tolist()) == {1, 2, 3, 4}
    covered = {int(w) for b, n in zip(begin, lengths) for w in range(b, b + n)}
    assert covered == set(range(170))


def test_dictionaries_of_a_rare_label_are_trained_and_of_one_size():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    many, few = ([" ".join(r.choice(vocabulary) for _ in range(150)).encode()[:quality.BLOCK] for _ in range(n)] for n in (3000, 600))
    good, bad = quality._dictionaries(many, few)
    assert good[:4] == bad[:4] == b"\x37\xa4\x30\xec"   # the mark of trained dictionaries
    assert len(good) <= sum(map(len, few)) // 20 and abs(len(good) - len(bad)) < len(good) // 10
    one, other = quality._dictionaries([b"few words"], [b"other words", b"more"])
    assert one == b"few words" and other in (b"other wordsmore", b"moreother words")   # no word is lost
    assert quality._dictionaries([], many)[0] == b""
