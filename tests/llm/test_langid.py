import random
import zlib

import numpy as np
import pytest

from shelfwatch.llm import langid
from shelfwatch.llm.bigru import BiGRU, pooled, segments

VOCABULARY = {
    "en": "the of and that with from have this which their would there".split(),
    "de": "der die und nicht mit sich auf für über können schön weiß".split(),
    "fr": "le les des que dans qui être à où déjà très français".split(),
}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(3, 60))), lang)
            for i, lang in ((i, rng.choice(list(VOCABULARY))) for i in range(n))]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = BiGRU(3, hidden=3)
    net.weights = {n: w.astype(np.float64) for n, w in net.weights.items()}
    data, lengths, labels = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([6, 3, 1, 6]), np.array([0, 1, 2, 1])
    _, grads = net.gradients(data, lengths, labels)
    for name, w in net.weights.items():
        for index in {tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)} | ({(int(data[0, 0]), 0)} if name[:2] == "in" else set()):
            before = w[index]
            w[index] = before + 1e-3
            up = net.gradients(data, lengths, labels)[0]
            w[index] = before - 1e-3
            down = net.gradients(data, lengths, labels)[0]
            w[index] = before
            assert grads[name][index] == pytest.approx((up - down) / 2e-3, abs=3e-4), name


def test_pooling_covers_every_byte_once():
    rng = random.Random(2)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 128, 129, 0, 700, 5)]
    data, lengths, owner = segments(raw)
    for i, text in enumerate(raw):
        assert b"".join(data[k, : lengths[k]].tobytes() for k in np.flatnonzero(owner == i)) == text
    net = BiGRU(4)
    whole = pooled(net, raw, 4)
    for i, text in enumerate(raw):  # does not depend on the texts around it
        assert np.allclose(whole[i], pooled(net, [text], 4)[0], atol=1e-5)
        assert len(text) == 0 or whole[i].sum() == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy(docs_of):
    rows = texts(700)
    docs = docs_of(rows)
    found = langid.predict(docs, langid.fit(docs)).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    lang = {i: label for i, _, label in rows}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_learned(docs_of):
    """Other labels of held-out documents change nothing."""
    rows = texts(300)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    results = [sorted(map(tuple, langid.predict(d, langid.fit(d)).collect())) for d in (docs_of(rows), docs_of(other))]
    assert results[0] == results[1]


def test_awkward_rows(awkward, empty, docs_of):
    found = langid.predict(awkward, langid.fit(awkward)).collect()
    assert len(found) == 13
    for r in found:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    unlabelled = docs_of([(1, "words", None), (2, "123", None)])
    assert {r.lang_pred for r in langid.predict(unlabelled, langid.fit(unlabelled)).collect()} == {"und"}
    assert langid.recognised(unlabelled).count() == 0
    kept = langid.recognised(docs_of([*texts(60), (1000, "12 34", "en"), (1001, None, None)]))
    assert {r.doc_id for r in kept.collect()} == set(range(60))
