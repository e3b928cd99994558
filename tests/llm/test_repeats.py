import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

from shelfwatch import staging
from shelfwatch.llm import prefix_doubling, repeats, suffix_trees, windows as win

W = win.WINDOW


def words(text):
    return (text or "").encode().split()


def removed(rows, units):
    """(units, gone) of every row: brute force over all windows."""
    first = {}
    for i, text in rows:
        u = units(text)
        for s in range(len(u) - W + 1):
            key = tuple(u[s : s + W])
            first[key] = min(first.get(key, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for s in range(len(u) - W + 1):
            if first[tuple(u[s : s + W])] < (1 << 61 if i is None else i):
                gone[s : s + W] = [True] * W
        out.append((i, u, gone))
    return out


def words_expected(rows):
    return sorted(((i, len(u), sum(g), " ".join(w.decode() for w, x in zip(u, g) if not x)) for i, u, g in removed(rows, words)), key=str)


def bytes_expected(rows):
    out = []
    for i, u, g in removed(rows, lambda t: (t or "").encode()):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((i, len(u), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(u, g) if not x)).hexdigest()))
    return sorted(out, key=str)


def words_found(docs):
    return sorted(map(tuple, suffix_trees.dedup_substrings(docs).collect()), key=str)


def bytes_found(docs):
    rows = prefix_doubling.dedup_substrings(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, prose, seed):
    rows = prose(80, seed)
    docs = docs_of(rows)
    assert words_found(docs) == words_expected(rows)
    assert bytes_found(docs) == bytes_expected(rows)


@pytest.mark.parametrize("limit", [2, 8])
def test_trees_below_longer_prefixes(docs_of, prose, monkeypatch, limit):
    """Passages that many documents share, so that every length of prefix is in use."""
    rows = prose(60, 6, words=(10, 60), share=0.9)
    monkeypatch.setattr(suffix_trees, "GROUP_LIMIT", limit)
    assert words_found(docs_of(rows)) == words_expected(rows)


def test_texts_of_few_symbols(docs_of, prose):
    """Windows that repeat inside a document and overlap themselves."""
    rows = [(i, t) for i, t in prose(40, 3, vocabulary=2)] + [(100 + i, "ab " * (30 + i)) for i in range(12)]
    docs = docs_of(rows)
    assert words_found(docs) == words_expected(rows)
    assert bytes_found(docs) == bytes_expected(rows)


def test_anchors_with_too_many_contents(docs_of, prose, monkeypatch):
    rows = prose(60, 4)
    monkeypatch.setattr(suffix_trees, "GROUP_LIMIT", 1)
    monkeypatch.setattr(prefix_doubling, "GROUP_LIMIT", 1)
    assert words_found(docs_of(rows)) == words_expected(rows)
    assert bytes_found(docs_of(rows)) == bytes_expected(rows)


def test_long_texts_are_cut_into_blocks(docs_of, prose, monkeypatch):
    monkeypatch.setattr(win, "BLOCK", 64)
    units = np.arange(1000, dtype=np.uint64)
    starts = [s for p in win.pieces(0, units, [(10, 5), (300, 200)]) for s in range(p.first, p.first + len(p.units) - W + 1)]
    assert starts == [s for s in range(951) if not 10 <= s < 15 and not 300 <= s < 500]
    rows = prose(20, 5)
    found = {}
    for i, t in rows:
        u = prefix_doubling.byte_units(t)
        for runs in win.anchors(win.pieces(i, u), 24):
            for row, first, n, key in zip(runs.row, runs.first, runs.count, runs.key):
                for s in range(first, first + n):
                    assert found.setdefault(u[s : s + W].tobytes(), key) == key


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert words_found(awkward) == words_expected(rows)
    assert [r[:3] for r in bytes_found(awkward)] == [r[:3] for r in bytes_expected(rows)]
    assert words_found(empty) == [] and bytes_found(empty) == []


def test_in_task_classes_match_plain_grouping():
    rng = np.random.default_rng(1)
    contents = [rng.integers(0, 2, rng.integers(W, W + 20)).astype(np.uint8) for _ in range(40)]
    contents += [c.copy() for c in contents[:20]]
    docs = rng.integers(0, 1000, len(contents))
    least = {}
    for c, d in zip(contents, docs):
        for s in range(len(c) - W + 1):
            least[c[s : s + W].tobytes()] = min(least.get(c[s : s + W].tobytes(), 1 << 60), d)
    expected = [least[c[s : s + W].tobytes()] for c in contents for s in range(len(c) - W + 1)]
    keys = np.zeros(len(contents), np.int64)
    assert prefix_doubling.doubled_earliest(keys, contents, docs).tolist() == expected
    assert suffix_trees.tree_earliest(keys, [c.astype(np.uint64) for c in contents], docs).tolist() == expected
    assert repeats.run_lengths(np.array([5, 5, 2, 5])) == [(0, 2, 5), (2, 1, 2), (3, 1, 5)]


def test_dealt_runs_take_no_more_bytes_in_more_buckets():
    """Disk at any size: buckets grow with the input, what a run takes on its way must not."""
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3000)) for _ in range(200)]
    rows = pa.table({"doc": np.arange(200) * 7919, "rid": np.arange(200), "text": texts,
                     "ranges": pa.nulls(200, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))})
    n_runs = sum(len(r.row) for i, t in enumerate(texts) for r in win.anchors(win.pieces(i, prefix_doubling.byte_units(t)), 26))
    size = {}
    for buckets in (12, 600):
        packed = pa.Table.from_batches(list(repeats._anchor_rows(prefix_doubling.byte_units, 26, buckets)(iter(rows.to_batches()))))
        values = [v for c in packed.columns if pa.types.is_binary(c.type) for v in c.to_pylist() if v]
        size[buckets] = sum(map(len, values)) / n_runs
    assert size[600] < 17 and size[600] < 1.05 * size[12]


def test_blocks_of_few_runs(docs_of, prose, monkeypatch):
    """Documents cut across blocks, rows that occur twice, and ids used twice."""
    monkeypatch.setattr(repeats, "BLOCK_RUNS", 3)
    rows = prose(40, 7)
    rows += rows[:6] + [(rows[0][0], rows[1][1] + " more"), (None, rows[2][1])]
    assert words_found(docs_of(rows)) == words_expected(rows)
    assert bytes_found(docs_of(rows)) == bytes_expected(rows)


def test_places_of_any_distance():
    at = np.array([0, 1, 70000, 70001, 5, 65539, 65540 + 65535, 9, 1 << 31])
    begin, sizes = np.array([0, 4, 7]), np.array([4, 3, 2])
    steps, far, n_far = repeats._steps(at, begin)
    assert n_far.tolist() == [1, 1, 1] and len(far) == 3
    assert repeats._places(steps, far, begin, sizes).tolist() == at.tolist()


def test_only_what_is_left_to_read_stays_on_disk(spark, docs_of, prose):
    found = prefix_doubling.removed_bytes(repeats.identified(docs_of(prose(30, 8))))
    own = staging._own_folder(spark).removeprefix("file:")
    before = set(os.listdir(own))
    again = prefix_doubling.removed_bytes(repeats.identified(docs_of(prose(30, 8))))
    assert [name.rpartition("-")[0] for name in set(os.listdir(own)) - before] == ["repeats"]
    assert found.count() == again.count() > 0
