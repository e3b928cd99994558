import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import binary_fuse, exact_dedup as x


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30000])
def test_filter_holds_its_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    made = binary_fuse.build(keys)
    assert binary_fuse.contains(made, keys).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 64, 20000, dtype=np.uint64)
    assert binary_fuse.contains(made, others).mean() < 0.01
    assert len(made[3]) < 1.6 * n + 200


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(docs, part="pmod(xxhash64(doc_id), 2) = 0"):
    rows = x.dedup(docs.filter(part), docs.filter(f"NOT ({part})"))
    return sorted(map(tuple, rows.drop("in_snapshot").collect()), key=str)


def test_against_brute_force(docs_of, prose):
    rows = prose(120) + [(1000 + i, t) for i, t in prose(40)]
    assert found(docs_of(rows)) == brute(rows)


def test_all_old_and_all_new(docs_of, prose):
    rows = prose(30) + [(100 + i, t) for i, t in prose(10)]
    for part in ("true", "false"):
        assert found(docs_of(rows), part) == brute(rows)


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == brute(rows)
    assert x.dedup(empty, empty).count() == 0


def test_texts_that_differ_are_not_merged(spark, docs_of, monkeypatch):
    """Two texts with one digest, as a broken hash would give: the byte check parts them."""
    old, new = docs_of([(1, "abc")]), docs_of([(2, "abd")])
    same = F.lit("0" * 64)
    classes = spark.createDataFrame([("0" * 64, 1, 1)], "digest string, first_id long, n_rows long")
    snapshot = x.write_snapshot(classes)
    incoming = spark.createDataFrame([("0" * 64, 2, 1)], "digest string, first_id long, n_rows long")
    real = F.sha2
    monkeypatch.setattr(x.F, "sha2", lambda *a: same)
    try:
        assert x.confirmed(spark, snapshot, incoming, old, new).count() == 0
        assert x.confirmed(spark, snapshot, incoming, old, docs_of([(2, "abc")])).count() == 1
    finally:
        monkeypatch.setattr(x.F, "sha2", real)
