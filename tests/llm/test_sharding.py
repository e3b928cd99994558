import random
import zlib

from shelfwatch.llm import packing, sharding


def naive_best_fit(sizes, capacity):
    rooms, bins = [], []
    for size in sizes:
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size and room > 0]
        if fitting:
            _, i = min(fitting)
        else:
            i = len(rooms)
            rooms.append(capacity)
        rooms[i] -= size
        bins.append(i)
    return bins


def test_tree_packs_as_a_plain_search():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 300):
        sizes = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
        assert packing.best_fit(sizes, 100) == naive_best_fit(sizes, 100)


def test_pack_into_a_number_of_bins():
    rng = random.Random(3)
    for n in (1, 3, 16, 200, 2000):
        sizes = sorted((rng.randint(1, 1000) for _ in range(n)), reverse=True)
        bins = packing.pack_into(sizes, 16)
        loads = [0] * 16
        for s, b in zip(sizes, bins):
            loads[b] += s
        assert max(loads) <= sum(sizes) / 16 + max(sizes)


def check(rows, shards=16):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_contract(docs_of, prose):
    texts = prose(400) + [(1000 + i, "a copy that many share") for i in range(200)]
    rows = sharding.contract_rows(docs_of(texts)).collect()
    check(rows)
    by_id = dict(texts)
    shard_of, loads = {}, [0] * 16
    for r in rows:
        raw = by_id[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert shard_of.setdefault(by_id[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 16


def test_fixed_capacity(docs_of, prose):
    docs = docs_of(prose(200))
    rows = sharding.shard(docs, capacity=8000).collect()
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) <= 8000
    assert len(loads) <= sum(loads.values()) // 8000 + 2


def test_many_shards_of_a_small_capacity(docs_of, prose, monkeypatch):
    """Many more shards than ``shards`` expects, packed in parts of 4."""
    monkeypatch.setattr(sharding, "PACKED_SHARDS", 4)
    texts = [(i, f"t{i}") for i in range(3000)] + prose(100)
    rows = sharding.shard(docs_of(texts), shards=2, capacity=2500).collect()
    loads, groups = {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        groups[r.group_key] = groups.get(r.group_key, 0) + r.size
    assert len(rows) == len(texts)
    assert all(load <= 2500 or load in groups.values() for load in loads.values())  # a larger group is alone
    assert sorted(loads) == list(range(len(loads)))
    expected = -(-sum(loads.values()) // 2500)
    assert len(loads) <= 1.5 * expected + 4
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(awkward, empty):
    rows = sharding.contract_rows(awkward).collect()
    assert len(rows) == 13
    check(rows)
    assert sharding.contract_rows(empty).count() == 0
