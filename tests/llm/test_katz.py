import math
import zlib
from collections import Counter

import pytest

from shelfwatch.llm import katz


def tokens(text):
    return (text or "").encode().lower().split()


class Brute:
    """The same model on plain dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
        self.words = Counter(w for line in train for w in [*line, None])
        self.pairs = Counter(p for line in train for p in zip(["<s>", *line], [*line, None]))
        self.pairs = Counter({p: n for p, n in self.pairs.items() if n >= katz.STORED})
        self.totals = Counter(h for line in train for h in ["<s>", *line])
        self.n = sum(self.words.values())
        d1 = katz.good_turing(Counter(self.words.values()), 1)
        d2 = katz.good_turing(Counter(self.pairs.values()), katz.STORED)
        mass = {w: c * d1.get(c, 1) for w, c in self.words.items()}
        scale = min(1, self.n * (1 - 0.5 / (self.n + 1)) / sum(mass.values())) if mass else 1
        self.uni = {w: m * scale / self.n for w, m in mass.items()}
        self.unknown = 1 - sum(self.uni.values())
        self.bi, self.weight = {}, {}
        by = {}
        for (h, w), c in self.pairs.items():
            by.setdefault(h, {})[w] = c * d2.get(c, 1)
        for h, found in by.items():
            total, m = self.totals[h], sum(found.values())
            s = min(1, (1 - 0.5 / (total + 1)) * total / m)
            self.bi |= {(h, w): s * x / total for w, x in found.items()}
            self.weight[h] = (1 - s * m / total) / (1 - sum(self.uni[w] for w in found))

    def p(self, h, w):
        return self.bi.get((h, w)) or self.weight.get(h, 1) * self.uni.get(w, self.unknown)

    def score(self, text):
        line = tokens(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *line], [*line, None]))

    def base(self, text):
        v = len(self.words)
        return sum(math.log10((self.words.get(w, 0) + 0.1) / (self.n + 0.1 * (v + 1))) for w in [*tokens(text), None])


def check(docs, rows):
    model, found = Brute(rows), katz.score(docs).collect()
    key = lambda i, s: (str(i), round(s, 6))
    expected = sorted((*key(i, model.base(t)), round(model.score(t), 5), len(tokens(t)) + 1,
                       sum(model.words.get(w, 0) > 0 for w in [*tokens(t), None])) for i, t in rows)
    got = sorted((*key(r.doc_id, r.base_score), round(r.score, 5), r.n_tokens, r.n_known) for r in found)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=2e-4)
    assert {r.train_tokens for r in found} <= {model.n}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in found)
    return model


def test_against_plain_dictionaries(docs_of, prose):
    rows = prose(150, 2, vocabulary=60)
    model = check(docs_of(rows), rows)
    for h in ["<s>", *list(model.words)[:40], b"never seen"]:  # exactly normalised
        assert sum(model.p(h, w) for w in [*model.words, b"unseen word"]) == pytest.approx(1)
    held = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    assert sum(map(model.score, held)) > sum(map(model.base, held))


def test_packs_of_a_few_entries(docs_of, prose, monkeypatch):
    monkeypatch.setattr(katz, "PACK_WORDS", 50)
    rows = prose(40, 3)
    check(docs_of(rows), rows)


def test_awkward_rows(awkward, empty, docs_of):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    check(awkward, rows)
    assert katz.score(empty).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    check(docs_of([(i, "only held out") for i in held]), [(i, "only held out") for i in held])


def test_discounts():
    found = katz.good_turing({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 50}, 1)
    assert set(found) == {1, 2, 3, 4, 5} and all(0 < d < 1 for d in found.values())
    assert katz.good_turing({}, 1)[1] == 0.5


def test_every_training_bigram_counts(docs_of, prose):
    rows = prose(120, 5, vocabulary=150)
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    seen = Counter(p for line in train for p in zip(["<s>", *line], [*line, None]))
    assert {1, 2} < set(seen.values())
    assert check(docs_of(rows), rows).pairs == {p: n for p, n in seen.items() if n >= 1}


def test_many_packs_of_bigrams(docs_of, prose, monkeypatch):
    monkeypatch.setattr(katz, "PACK_BIGRAMS", 3)
    rows = prose(30, 6)
    check(docs_of(rows), rows)


def test_no_table_of_bigrams_is_written(docs_of, prose, monkeypatch):
    written, staged = {}, katz.staged

    def counted(df, label):
        out = staged(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(katz, "staged", counted)
    rows = prose(120, 8, vocabulary=150)
    model = check(docs_of(rows), rows)
    assert max(written.values()) < 400 < len(model.pairs) / 10


def test_packs_name_a_word_once(prose):
    lines = [[katz.START, *katz.Hashes().of(t), katz.END] for _, t in prose(60, 9, vocabulary=100)]
    deal = katz.Deal(3, katz.np.array([katz.START], katz._U))
    line, lengths = katz.np.array(sum(lines, []), katz._U), katz.np.array([len(x) for x in lines])
    train = katz.np.arange(len(lines)) % 3 > 0
    packs = list(katz._packed((0, 0), katz.np.arange(len(lines)), train, line, lengths, deal))
    assert len(packs) == 3 and sum(len(raw) for _, raw in packs) < 5 * len(line)
    found = Counter()
    for _, raw in packs:
        h, w, n = katz.Pack.loaded(katz.pickle.loads(raw)).bigrams()
        found.update({(int(a), int(b)): int(c) for a, b, c in zip(h, w, n) if c})
    assert found == Counter(p for line, t in zip(lines, train) if t for p in zip(line, line[1:]))


def test_equal_bigrams_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(katz, "PACK_BIGRAMS", 3)
    found = katz.Bigrams()
    for part in ([5, 5, 9], [1, 7, 2], [1, 4, 0]), ([5, 9], [7, 2], [2, 0]), ([9, 5], [2, 1], [6, 1]), ([5], [1], [1]):
        found.add(*(katz.np.array(x, t) for x, t in zip(part, ("u8", "u8", "i8"))))
    assert [x.tolist() for x in found.stored()] == [[5, 5, 9], [1, 7, 2], [3, 6, 6]]
