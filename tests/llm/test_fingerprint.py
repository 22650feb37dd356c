import hashlib
import random

from assayer.llm import fingerprint


def test_edits_follow_the_order_of_ids(spark, docs):
    r = random.Random(4)
    texts = [" ".join(r.choice(["äx", "b", "c😀", "d"]) + str(r.randint(0, 20)) for _ in range(r.randint(0, 60))) for _ in range(120)]
    texts[5], texts[9], texts[11] = None, "", texts[10]
    ids = r.sample(range(-500, 5000), len(texts))
    found = {x.doc_id: x for x in fingerprint.edit_likeness(docs(texts, ids)).collect()}
    rows = sorted((i, t or "") for i, t in zip(ids, texts))
    for k, (i, text) in enumerate(rows):
        after_id, after = rows[(k + 1) % len(rows)]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = [bytes.fromhex(f) for f in (found[i].fingerprint, found[after_id].fingerprint)]
        assert found[i].near_next == sum(bits[0][2 * j:2 * j + 2] == bits[1][2 * j:2 * j + 2] for j in range(128)) / 128
        if edited == text:
            assert found[i].fingerprint == found[i].edited_fingerprint and found[i].near_edited == 1
    assert found[ids[10]].fingerprint == found[ids[11]].fingerprint


def test_likeness_estimates_jaccard(spark, docs):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:300] + [f"v{i}" for i in range(100)]), "other words altogether stand here"]
    found = {r.doc_id: r for r in fingerprint.edit_likeness(docs(texts)).collect()}
    assert abs(found[0].near_next - 296 / 496) < 0.15
    assert found[1].near_next < 0.05


def test_odd_rows(spark, docs):
    found = fingerprint.edit_likeness(docs(["b c", "a b c d e f g h", None, "", "x"], [1, 1, 7, 7, None])).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, 1, 3, 15]
    assert [r.near_next for r in found if r.n_chars == 0].count(1.0) == 1   # the two empty texts follow each other
    assert fingerprint.edit_likeness(docs(["a"]).limit(0)).count() == 0
    assert fingerprint.edit_likeness(docs(["a b"])).first().near_next == 1
