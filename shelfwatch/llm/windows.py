"""Numpy helpers on sequences of units: span hashes, content-cut chunks, anchors.

Units are 64-bit hashes of words, or bytes, which a fixed table turns into 64 bits.

A window is ``WINDOW`` consecutive units. A *piece* is a range of window starts of one
document with the units that these windows cover. Pieces are hashed in blocks.

The hash of any span comes from two prefix sums of ``unit * BASE**position`` (modulo
``2**64``; BASE is odd and so has an inverse), hence equal contents have equal hashes
wherever they lie.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np

WINDOW = 50
BLOCK = 1 << 20  # window starts hashed at once
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POSITIONS = 22  # bits that hold a position in a block
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses for i < n."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=_U)
    return _tables["up"][:n], _tables["down"][:n]


_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=_U)


def as_units(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw] if raw.dtype == np.uint8 else raw


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Spans:
    """Hashes of spans of one array of units."""

    def __init__(self, units: np.ndarray):
        up, self._down = _powers(len(units) + 1)
        self._sums = np.zeros(len(units) + 1, _U)
        np.cumsum(units * up[:-1], dtype=_U, out=self._sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every ``k`` consecutive units."""
        return mixed((self._sums[k:] - self._sums[:-k]) * self._down[: len(self._sums) - k])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach, found = 1, values
    while reach * 2 <= width:
        found = np.minimum(found[:-reach], found[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        found = np.minimum(found[:-rest], found[rest:])
    return found


@dataclass(frozen=True)
class Piece:
    row: int  # of the batch
    first: int  # window start in the document
    units: np.ndarray  # of all windows: one for each start, and WINDOW - 1 more


def pieces(row: int, units: np.ndarray, without: Iterable[tuple[int, int]] = ()) -> Iterator[Piece]:
    """The window starts of a document but for the ranges (start, count) ``without``, BLOCK at most at a time."""
    starts, at = len(units) - WINDOW + 1, 0
    for skip, count in [*sorted(without), (starts, 0)]:
        for first in range(at, min(skip, starts), BLOCK):
            n = min(BLOCK, min(skip, starts) - first)
            yield Piece(row, first, units[first : first + n + WINDOW - 1])
        at = max(at, skip + count)


@dataclass(frozen=True)
class Runs:
    """Ranges of window starts: rows of the batch, first start, number, hash of all units, key.

    ``left`` and ``right`` are hashes of the units before and after an anchor. Every
    window holds one of the two stretches whole, so equal windows have equal anchors and
    an equal ``left`` or ``right``.
    """

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    content: np.ndarray
    key: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _blocks(found: Iterable[Piece]) -> Iterator[list[Piece]]:
    held, size = [], 0
    for piece in found:
        if held and size + len(piece.units) > BLOCK + WINDOW:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece.units)
    if held:
        yield held


def _laid_out(block: list[Piece]):
    """Units of a block, the positions of its window starts, and what turns them into document positions."""
    units = as_units(np.concatenate([p.units for p in block]))
    lengths = np.array([len(p.units) for p in block])
    counts = lengths - (WINDOW - 1)
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(block)), counts)
    starts = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    rows = np.array([p.row for p in block])
    shift = np.array([p.first for p in block]) - begins
    return units, starts, owner, rows, shift


def _runs(cut: np.ndarray, spans: Spans, starts, owner, rows, shift) -> tuple[np.ndarray, Runs]:
    """The cuts, and runs without anchors."""
    begin = np.flatnonzero(cut)
    count = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    content = spans.hashes(first, first + count + (WINDOW - 1))
    own = owner[begin]
    none = np.zeros(len(begin), _U)
    return begin, Runs(rows[own], first + shift[own], count, content, content, none, none)


def chunks(found: Iterable[Piece], mean: int, gram: int) -> Iterator[Runs]:
    """Cut window starts into chunks of ``mean`` starts on average, where the content says so."""
    for block in _blocks(found):
        units, starts, owner, rows, shift = _laid_out(block)
        spans = Spans(units)
        cut = spans.grams(gram)[starts] % _U(mean) == 0
        cut[0] = True
        cut[1:] |= owner[1:] != owner[:-1]
        yield _runs(cut, spans, starts, owner, rows, shift)[1]


def anchors(found: Iterable[Piece], gram: int) -> Iterator[Runs]:
    """Runs of windows that share an anchor: the ``gram`` units of least hash inside the window.

    Equal windows have equal anchors, so only runs with a key in common can hold equal
    windows.
    """
    width, low = WINDOW - gram + 1, _U((1 << _POSITIONS) - 1)
    for block in _blocks(found):
        units, starts, owner, rows, shift = _laid_out(block)
        spans = Spans(units)
        grams = spans.grams(gram)
        packed = (grams & ~low) | np.arange(len(grams), dtype=_U)
        least = (sliding_minimum(packed, width)[starts] & low).astype(np.int64)
        cut = np.ones(len(starts), bool)
        cut[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        begin, runs = _runs(cut, spans, starts, owner, rows, shift)
        at, beside = least[begin], (WINDOW - gram) // 2
        # windows that hold the stretch on one side exist only where it lies in the piece
        from_, to = np.maximum(at - beside, 0), np.minimum(at + gram + beside, len(units))
        left, right = spans.hashes(from_, at), spans.hashes(np.minimum(at + gram, to), to)
        yield replace(runs, key=grams[at], left=left, right=right)


def covered(length: int, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which units the windows starting in the given ranges cover."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, firsts, 1)
    np.add.at(edges, firsts + counts + (WINDOW - 1), -1)
    return np.cumsum(edges[:-1]) > 0
