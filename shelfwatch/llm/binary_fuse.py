"""Static binary-fuse filters (three slots, 8-bit fingerprints) over 64-bit keys.

A key is in the set only if its fingerprint equals the XOR of its three slots,
which lie in three neighbouring segments. There are no false negatives, and about
one foreign key in 256 passes. Construction peels slots that only one key uses, a
whole round of them at a time, and fills the slots in the reverse order.
"""

import math

import numpy as np

_U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ _U(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(33))


def _slots(hashes: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots per hash, one row each."""
    first = ((hashes >> _U(32)) * _U(count * segment)) >> _U(32)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((hashes >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> _U(32))) & _U(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, slots) for distinct ``uint64`` keys; no keys are fine."""
    n = len(keys)
    segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    load = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * load / segment) - 2)
    for attempt in range(1, 200):
        seed = (attempt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        hashes = _mixed(keys, seed)
        where = _slots(hashes, segment, count)
        used = np.zeros((count + 2) * segment, np.int64)
        owner = np.zeros(len(used), np.int64)
        for row in where:
            np.add.at(used, row, 1)
            np.bitwise_xor.at(owner, row, np.arange(n))
        order, ready = [], np.flatnonzero(used == 1)
        while len(ready):
            own, first = np.unique(owner[ready], return_index=True)
            order.append((own, ready[first]))
            touched = where[:, own]
            for row in touched:
                np.subtract.at(used, row, 1)
                np.bitwise_xor.at(owner, row, own)
            touched = np.unique(touched)
            ready = touched[used[touched] == 1]
        if sum(len(own) for own, _ in order) == n:
            prints, slots = _fingerprints(hashes), np.zeros(len(used), np.uint8)
            for own, slot in reversed(order):
                slots[slot] = 0
                a, b, c = where[:, own]
                slots[slot] = prints[own] ^ slots[a] ^ slots[b] ^ slots[c]
            return seed, segment, count, slots.tobytes()
        count += 1 + attempt // 8
    raise ValueError("keys are not distinct")


def contains(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set."""
    seed, segment, count, raw = filter_
    slots, hashes = np.frombuffer(raw, np.uint8), _mixed(keys, int(seed))
    a, b, c = _slots(hashes, int(segment), int(count))
    return (slots[a] ^ slots[b] ^ slots[c]) == _fingerprints(hashes)
