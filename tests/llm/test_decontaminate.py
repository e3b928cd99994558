import itertools
import random
import re

import pytest

from shelfwatch.llm import decontaminate as d


@pytest.fixture
def items(spark):
    def build(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return build


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def brute(docs, bench):
    """All alignments of every document and item that some seed can find."""
    found = set()
    for i, text in docs:
        w = tokens(text)
        for k, item in bench:
            b = tokens(item)
            n = min(d.WINDOW, len(b))
            if len(b) < d.SPAN or len(w) < d.SPAN:
                continue
            for shift in range(-len(b) + 1, len(w)):
                same = [0 <= p + shift < len(w) and w[p + shift] == b[p] for p in range(len(b))]
                seeded = any(
                    all(same[p + j] for j, c in enumerate(mask) if c == "1") and p + shift >= 0 and p + shift + d.SPAN <= len(w)
                    for mask in d.MASKS for p in range(len(b) - d.SPAN + 1)
                )
                lo, hi = max(0, -shift), min(len(b), len(w) - shift)
                over = same[lo:hi]
                best = max((sum(over[s : s + n]) for s in range(max(1, len(over) - n + 1))), default=0)
                if seeded and best >= -(-n * 8 // 10):
                    found.add((i, k))
    return found


def pairs(docs, bench):
    return {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}


def test_against_brute_force(docs_of, items):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    bench = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 40)))) for k in range(12)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        if i % 2:
            leak = rng.choice(bench)[1].split()
            for _ in range(i % 7):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = leak[rng.randrange(3):]
        docs.append((i, " ".join(words)))
    expected = brute(docs, bench)
    assert len(expected) > 10
    assert pairs(docs_of(docs), items(bench)) == expected


def test_one_changed_word_in_six_is_found(docs_of, items):
    words = [f"word{i}" for i in range(30)]
    changed = [w if i % 6 else "x" for i, w in enumerate(words)]
    docs = docs_of([(1, "A B c " + " ".join(changed).upper() + ", the end."), (2, " ".join(reversed(words))), (3, None)])
    assert pairs(docs, items([(9, " ".join(words))])) == {(1, 9)}
    assert {r.doc_id for r in d.decontaminated(docs, items([(9, " ".join(words))])).collect()} == {2, 3}


def test_awkward_rows(awkward, empty, items):
    bench = items([(1, "x " * 20), (2, None), (3, ""), (None, "y " * 20), (4, "x " * 20)])
    assert pairs(awkward, bench) == {(7, 1), (7, 4)}
    assert d.decontaminated(awkward, bench).count() == 12
    assert pairs(empty, bench) == set() and pairs(awkward, items([])) == set()


def test_main_path_is_native(docs_of, items):
    plan = d.contaminated(docs_of([(1, "a b")]), items([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_allowed_change_leaves_a_seed():
    assert set(d.SEEDS) == set(range(1, d.WINDOW + 1))
    for n, masks in d.SEEDS.items():
        spans = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            assert any(not span & set(changed) for span in spans), (n, changed)


def test_short_items_and_all_allowed_changes(docs_of, items):
    bench = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in range(1, 14)]
    docs, expected = [], set()
    for n, text in bench:
        most = n - -(-n * 8 // 10)
        for changed in range(most + 2):  # one more than allowed, too
            for places in itertools.combinations(range(n), min(changed, n)):
                words = ["x" if k in places else w for k, w in enumerate(text.split())]
                docs.append((len(docs), " ".join(["before", *words, "after"])))
                if changed <= most:
                    expected.add((len(docs) - 1, n))
    long = [f"l{k}" for k in range(30)]  # 13 of 30 tokens, two of them changed
    for places in itertools.combinations(range(13), 2):
        docs.append((len(docs), "before " + " ".join("x" if k in places else w for k, w in enumerate(long[9:22])) + " after"))
        expected.add((len(docs) - 1, 30))
    # one more change than allowed may still leave other short items whole: none share tokens here
    assert pairs(docs_of(docs), items([*bench, (30, " ".join(long))])) == expected
