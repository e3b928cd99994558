import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import grid_order, spectrum, whitening

SCHEMA = "vec_id long, embedding array<{}>, label int"


@pytest.fixture
def vectors_of(spark):
    def build(rows, kind="float"):
        return spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)

    return build


def clustered(n, d, seed, labels=3, spread=0.04):
    """Float vectors around few centres, so that many are near and chains form."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + spread * math.sqrt(d) * rng.standard_normal(d) * rng.random()
        rows.append((i, [float(x) for x in (v * rng.uniform(0.1, 9)).astype(np.float32)], int(rng.integers(labels))))
    return rows


def usable(row):
    v = row[1]
    return row[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    """(vec_id, n_links, component_id) sorted by repr."""
    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= 0.93:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((row[0], len(near[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def linked(table):
    rows = grid_order.near_duplicates(table).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in rows], key=repr)


@pytest.mark.parametrize("kind, d", [("float", 24), ("double", 3)])
def test_links_against_brute_force(vectors_of, monkeypatch, kind, d):
    monkeypatch.setattr(grid_order, "BLOCK", 16)  # many blocks and three levels
    monkeypatch.setattr(grid_order, "FAN", 3)
    rows = clustered(400, d, seed=d)
    found = linked(vectors_of(rows, kind))
    assert found == brute_links(rows)
    assert 50 < sum(n > 0 for _, n, _ in found)


def test_blocks_far_apart_are_skipped(vectors_of, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK", 16)
    rng = random.Random(1)
    turns = [rng.uniform(0, 2 * math.pi) for _ in range(1500)]
    rows = [(i, [math.cos(t), math.sin(t)], 1) for i, t in enumerate(turns)]
    nodes = vectors_of(rows).select("label", F.col("embedding").alias("vector"), F.col("vec_id").alias("least"), F.lit(1).cast("long").alias("copies"))
    basis = grid_order.directions(nodes, 2)
    blocked, blocks = grid_order.numbered_blocks(grid_order.sequence(nodes, basis))
    pairs = {tuple(p) for p in grid_order.block_pairs(blocked, blocks, 2).collect()}
    assert blocks >= 90 and len(pairs) < blocks * (blocks + 1) / 4
    boxes = {r.block: r for r in blocked.groupBy("block").agg(*[f(F.col("place")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in (0, 1)]).collect()}
    for a in boxes:
        for b in boxes:
            gaps = [max(boxes[a][f"min{i}"] - boxes[b][f"max{i}"], boxes[b][f"min{i}"] - boxes[a][f"max{i}"], 0) for i in (0, 1)]
            if a <= b and math.hypot(*gaps) < grid_order.EPSILON:
                assert (a, b) in pairs


def test_many_copies_and_a_dense_group(vectors_of, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK", 32)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 5) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in np.float32([1, 2, 3, 4] + 0.1 * rng.standard_normal(4))], 5) for i in range(200)]
    rows += [(2000 + i, [1.0, 2.0, 3.0, 4.0], 6) for i in range(5)]
    assert linked(vectors_of(rows)) == brute_links(rows)


def test_threshold_itself_links(vectors_of):
    other = [0.93, math.sqrt(1 - 0.93**2)]
    rows = [(1, [1.0, 0.0], 1), (2, other, 1), (3, [0.93, other[1] * (1 + 1e-12)], 1), (4, [-1.0, 0.0], 1)]
    assert linked(vectors_of(rows, "double")) == brute_links(rows)


def awkward_rows():
    nan, inf = float("nan"), float("inf")
    return [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 1.0], 1), (5, [nan, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0], 1),
        (7, [1.0, 1.0, 1.0], None), (8, [1.0, 1.0, 1.0], 1), (9, [2.0, 2.0, 2.0], 1), (9, [2.0, 2.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1),
        (None, [-1.0, 1.0, 5.0], 2), (None, [-1.0, 1.0, 5.0], 2), (10, [1.0, 1.0], 1), (11, [1.0, 1.01], 1), (9, [-3.0, 0.0, 1.0], 1),
        (12, [1e-30, 1e-30, 1e-30], 1), (13, [1e30, 1e30, 1.001e30], 1), (14, [-0.0, 1.0, 0.0], 3), (15, [0.0, 1.0, 0.0], 3), (16, [1.0] * 5000, 1),
    ]


def test_awkward_vectors(vectors_of):
    rows = awkward_rows()
    table = vectors_of(rows)
    for name in ("vector", "least", "copies", "pos", "place", "block", "root", "links", "n_links", "component_id", "kept"):
        table = table.withColumn(name, F.lit("clash"))
    result = grid_order.near_duplicates(table).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in result], key=repr) == brute_links(rows)
    assert grid_order.near_duplicates(table.limit(0)).count() == 0
    assert linked(vectors_of(rows[:7])) == brute_links(rows[:7])


# --- whitening ---


def test_inertia_counts_and_eigenvectors():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 30):
        for kind in range(4):
            q, _ = np.linalg.qr(rng.standard_normal((n, n)))
            w = [rng.random(n) + 0.1, np.ones(n), 10.0 ** (-12 * rng.random(n)), np.r_[np.zeros(n // 2), rng.random(n - n // 2)]][kind]
            a = (q * w) @ q.T
            a = (a + a.T) / 2
            true = np.linalg.eigvalsh(a)[::-1]
            for shift in rng.uniform(-0.2, 1.2, 6):
                assert spectrum.above(a, shift) == (true > shift).sum()
            found = spectrum.leading(a, 8)
            values, vectors = np.array([v for v, _ in found]), np.array([v for _, v in found]).T
            assert np.allclose(values, true[: len(found)], rtol=0, atol=1e-13 * true[0])
            assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
            assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * true[0]
            assert len(found) == min(8, n) or true[len(found)] < 1e-11 * true[0]


def brute_whitened(rows, count=8):
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return [i for i, _ in kept], n, deviation, c @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening_against_numpy(vectors_of):
    rows = clustered(500, 12, seed=8) + [(1000, None, 1), (1001, [float("nan")] + [0.0] * 11, 1), (1002, [None] * 12, 1)]
    ids, n, deviation, whitened, explained = brute_whitened(rows)
    found = {(r.vec_id, r.component): r for r in whitening.whiten(vectors_of(rows)).collect()}
    assert len(found) == 8 * len(ids)
    for c in range(8):
        mine = np.array([found[i, c + 1].whitened for i in ids])
        theirs = whitened[:, c] * np.sign(whitened[0, c] * mine[0])
        assert np.abs(mine - theirs).max() < 1e-9
        for k, i in enumerate(ids):
            r = found[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[k])
            assert math.isclose(r.explained, explained[c], rel_tol=1e-10) and r.identity_error < 1e-9


def test_deviations_beyond_a_long(vectors_of):
    rows = [(1, [4e12, 1.0], 1), (2, [-4e12, 2.0], 1), (3, [0.5, 3.0], 1), (4, [1e300, 0.0], 1)]
    found = whitening.whiten(vectors_of(rows, "double")).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and {r.n for r in found} == {3}
    assert all(r.deviation is None for r in found if r.vec_id != 3)
    assert len({r.deviation for r in found if r.vec_id == 3} - {None}) == 1


def test_rows_without_spread(vectors_of, spark):
    assert whitening.whiten(vectors_of([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    assert whitening.whiten(vectors_of([(1, [], 1)])).count() == 0
    assert whitening.whiten(vectors_of([(1, None, 1)])).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA.format("float"))).count() == 0
    line = whitening.whiten(vectors_of([(i, [float(i), 2.0 * i, 1.0], 1) for i in range(5)])).collect()
    assert len(line) == 5 and {r.component for r in line} == {1}
    assert abs(line[0].explained - 1) < 1e-12


def test_awkward_vectors_are_whitened(vectors_of):
    table = vectors_of(awkward_rows(), "double")
    for name in ("vector", "n", "i", "total", "place", "m", "component"):
        table = table.withColumn(name, F.lit("clash"))
    rows = whitening.whiten(table).collect()
    # of the three-dimensional ones, without null, NaN, infinite and too large ones
    kept = [r for r in awkward_rows() if r[1] and len(r[1]) == 3 and all(x is not None and abs(x) < 2**42 for x in r[1])]
    assert len(rows) == 3 * len(kept) and {r.n for r in rows} == {len(kept)}
