import itertools
import random

import pytest

from shelfwatch.llm import mixing as m


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = m.SHARE * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        goal = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return goal | fixed
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("table", [m.TABLE, 60])
def test_fit_is_the_best_subset_sum(table):
    rng = random.Random(4)
    for _ in range(60):
        sizes = rng.sample(range(1, 30), rng.randint(1, 4))
        counts = [rng.randint(1, 3) for _ in sizes]
        for budget in rng.sample(range(0, 80), 5):
            picks = m.fit_budget(sizes, counts, budget, table)
            assert all(0 <= p <= c for p, c in zip(picks, counts))
            got = sum(s * p for s, p in zip(sizes, picks))
            reach = {sum(s * p for s, p in zip(sizes, c)) for c in itertools.product(*(range(c + 1) for c in counts))}
            best = min(abs(r - budget) for r in reach)
            if budget <= table // 2:
                assert abs(got - budget) == best
            else:  # what is taken in proportion may cost a little of the optimum
                assert abs(got - budget) <= best + max(sizes)


def test_the_nearer_side_is_taken():
    assert m.fit_budget([40], [1], 23) == [1] and m.fit_budget([40], [1], 20) == [0]
    assert m.fit_budget([7, 40], [1, 1], 43) == [0, 1] and m.fit_budget([7, 40], [1, 1], 44) == [1, 1]


def test_fit_of_a_large_budget():
    sizes, counts = list(range(7, 400)), [1000] * 393
    budget = sum(s * c for s, c in zip(sizes, counts)) // 3 + 12345
    picks = m.fit_budget(sizes, counts, budget, table=4096)
    assert sum(s * p for s, p in zip(sizes, picks)) == budget


def test_targets_and_takings(docs_of, prose):
    rows = [(i, t, "en", ["b", "a", None, "c", "é"][i % 11 % 5] if i % 7 else "a") for i, t in prose(300)]
    found = m.mix(docs_of(rows)).collect()
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    goal = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 25 for s in sizes)
    again = m.mix(docs_of(rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_documents_are_repeated(docs_of, prose):
    docs = docs_of([(i, t, "en", f"s{i % 4}") for i, t in prose(100)])
    times = {r.doc_id: r.taken // r.size for r in m.mix(docs).collect()}
    rows = m.mixed_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, n in times.items() for _ in range(n))
    assert rows[0].asDict().keys() == set(docs.columns)


def test_equal_rows_share_what_is_taken(docs_of):
    """25 rows of 4 words in source b, equal but for their lang; 118 words are to be taken of them."""
    rows = [(5, "four words of text", "en" if i < 10 else "de", "b") for i in range(25)]
    rows += [(9 + i, "and six more words of another source", "en", "a") for i in range(9)]
    docs = docs_of(rows)
    taken = sum(r.taken for r in m.mix(docs).collect() if r.source == "b")
    assert taken % 100 != 0  # not the same for each
    kept = [r for r in m.mixed_documents(docs).collect() if r.source == "b"]
    assert len(kept) * 4 == taken
    assert {r.lang for r in kept} == {"en", "de"}
    assert sorted(map(str, kept)) == sorted(str(r) for r in m.mixed_documents(docs_of(rows[::-1])).collect() if r.source == "b")


def test_one_document_comes_near_its_target(docs_of):
    """A target of 63.3 for a document of 40 words is nearer to 80 than to 40."""
    rows = [(1, "w " * 40, "en", "a")] + [(2 + i, "x " * 10, "en", "b") for i in range(8)]
    found = {r.source: r for r in m.mix(docs_of(rows)).collect()}
    nearest = min((0, 40, 80), key=lambda t: abs(t - found["a"].target))
    assert found["a"].taken == nearest


def test_awkward_rows(awkward, empty):
    rows = m.mix(awkward).collect()
    assert len(rows) == 13
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) <= max(r.size for r in rows) * len({r.source for r in rows})
    assert m.mixed_documents(awkward).count() == sum(r.taken // r.size for r in rows if r.size)
    assert m.mix(empty).count() == 0 and m.mixed_documents(empty).count() == 0
