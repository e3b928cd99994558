"""Best-fit-decreasing bin packing with the open bins in a balanced search tree."""

import random


class CapacityTree:
    """Treap of (room, bin): ``take(size)`` removes and returns the bin with the least room that fits."""

    def __init__(self, seed: int = 7):
        self._root, self._random = None, random.Random(seed).random

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return [a[0], a[1], a[2], CapacityTree._merge(a[3], b)]
        return [b[0], b[1], CapacityTree._merge(a, b[2]), b[3]]

    @staticmethod
    def _split(node, key):
        """Subtrees with keys below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = CapacityTree._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = CapacityTree._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self._root, (room, bin_))
        self._root = self._merge(self._merge(low, [(room, bin_), self._random(), None, None]), high)

    def take(self, size: int):
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        path = high
        while path[2] is not None:
            path = path[2]
        found = path[0]
        _, rest = self._split(high, (found[0], found[1] + 1))
        self._root = self._merge(low, rest)
        return found


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; ``sizes`` must fall. A size over the capacity gets a bin of its own."""
    tree, bins, opened = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        room, bin_ = found if found else (capacity, opened)
        opened += found is None
        bins.append(bin_)
        if room > size:
            tree.add(room - size, bin_)
    return bins


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Bins of the smallest capacity found for which best fit opens at most ``shards`` bins.

    The capacity is searched between the mean load and the mean load plus the largest
    size, where best fit always suffices or plain least-loaded packing is used.
    """
    low = max(-(-sum(sizes) // shards), max(sizes, default=0))
    high, best = low + max(sizes, default=0), None
    for _ in range(40):
        if low >= high and best is not None:
            break
        middle = (low + high) // 2 if best is not None else low
        bins = best_fit(sizes, middle)
        if max(bins, default=0) < shards:
            best, high = bins, middle
        elif best is None:
            bins = best_fit(sizes, high)
            if max(bins, default=0) < shards:
                best, low = bins, middle + 1
            else:
                high *= 2
        else:
            low = middle + 1
    return best
