import itertools
import random

import pyarrow as pa
import pytest

from shelfwatch.llm import jaccard_join as j
from shelfwatch.llm.components import components


def sets_of(rows):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        both = len(x & y)
        if x and y and 100 * both >= 90 * (len(x) + len(y) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, j.similar_documents(docs).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.random()}"
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(docs_of, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, 5)):
            words = edited(rng, words, rng.randint(0, 3)) + [rng.choice(vocab)] * rng.randint(0, 1)
            rows.append((len(rows), (" ".join if rng.random() < 0.8 else "\n".join)(words)))
    rng.shuffle(rows)
    assert found(docs_of(rows)) == brute(rows)


def test_a_group_of_near_copies_and_chains(docs_of):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(80)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(80, 110):  # each links with the next, few with the others
        chain = edited(rng, chain, 1)
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, f"frequent line of words {i} here") for i in range(30)]
    assert found(docs_of(rows)) == brute(rows)


def test_copies_that_are_far_apart_do_not_meet(docs_of, monkeypatch):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(140)]
    rows = [(i, " ".join(edited(rng, base, 4))) for i in range(60)]  # eight shingles in nine are shared by any two
    rows += [(60 + i, " ".join(edited(rng, base, i))) for i in range(3)]
    pairs, rest = [], j.rest_pairs
    monkeypatch.setattr(j, "rest_pairs", lambda *a: pairs.append(rest(*a)) or pairs[0])
    assert found(docs_of(rows)) == brute(rows)
    assert pairs[0].count() <= len(rows)


def test_near_copies_meet_the_one_in_the_middle(docs_of, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 4))) for i in range(40)] + [(40, " ".join(base))]
    first, pairs = j.first_pairs, []
    monkeypatch.setattr(j, "first_pairs", lambda *a: pairs.append(first(*a)) or pairs[0])
    assert found(docs_of(rows)) == brute(rows)
    middle = j.signature(j.shingles(" ".join(base)))
    assert sum(middle in (r.a, r.b) for r in pairs[0].collect()) >= 38


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == brute(rows)
    assert found(empty) == []
    # Both rows with id 4 stay, as neither id is larger; 5 goes.
    kept = sorted((r.doc_id for r in j.one_of_each(awkward).collect()), key=str)
    assert kept == sorted([1, 2, 3, None, 4, 4, 6, 6, 7, 8, 9, None], key=str)


def test_rows_that_share_an_id_or_have_none(docs_of):
    rng = random.Random(12)
    rows = []
    for i in range(30):  # under one id, and under none, many texts; each with a near copy
        words = [f"s{rng.randrange(500)}" for _ in range(120)]
        rows += [(7 if i % 2 else None, " ".join(words)), (100 + i if i % 3 else None, " ".join(edited(rng, words, 1)))]
    rng.shuffle(rows)
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        assert found(docs_of(order)) == brute(order)


def test_a_wrong_text_is_not_kept():
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    near = texts[0] + " more"
    sig = [j.signature(j.shingles(t)) for t in (texts[0], near)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x) for x in ([sig[0]] * 2, [sig[1]] * 2, [texts[1], texts[0]], [near, near])], names=["a", "b", "text_a", "text_b"])
    assert sum(len(b) for b in j._texts_verified(3, j.SIMILARITY)([batch])) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(300):04}", f"{rng.randrange(300):04}") for _ in range(200)]
    edges += [(f"{1000 + i}", f"{1001 + i}") for i in range(150)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.component for r in rows} == {x: root(x) for x in parent if root(x) != x}


def test_text_pieces_hold_every_row_once():
    import pyarrow as pa

    from shelfwatch.llm.common import text_pieces

    texts = ["", "x" * 50, None, "y" * 7, "z" * 3, "", "w" * 9, "é" * 20]
    batch = pa.RecordBatch.from_pydict({"n": list(range(8)), "text": texts, "other": texts[::-1]})
    for columns in (("text",), ("text", "other")):
        for most in (1, 10, 60, 10_000):
            pieces = list(text_pieces(iter([batch, batch.slice(0, 0)]), *columns, most=most))
            assert [n for p in pieces for n in p.column("n").to_pylist()] == list(range(8))
            for p in pieces:
                size = sum(len((v or "").encode()) for c in columns for v in p.column(c).to_pylist())
                assert size <= most or p.num_rows == 1
