"""Leading eigenvectors of a symmetric matrix by spectrum slicing."""

import math

import numpy as np

# Growth bound of the pivoting: 2 x 2 pivots are taken where it keeps the factors smallest.
ALPHA = (1 + math.sqrt(17)) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``: the positive ones of D in LDLᵀ of the shifted matrix.

    The factorisation takes the largest diagonal entry as pivot, or the 2 x 2 block of
    the largest entry where the diagonal is too small; signs of D are those of the
    eigenvalues (Sylvester). A pivot of zero counts as not larger.
    """
    rest = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(rest):
        n = len(rest)
        diagonal = np.abs(np.diag(rest))
        k = int(diagonal.argmax())
        off = np.abs(rest)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), n)
        if not max(diagonal[k], off[i, j]):
            break
        pivots = [k] if diagonal[k] >= ALPHA * off[i, j] else [i, j]
        others = np.delete(np.arange(n), pivots)
        block, side = rest[np.ix_(pivots, pivots)], rest[np.ix_(others, pivots)]
        positive += int(block[0, 0] > 0) if len(pivots) == 1 else 1  # such a 2 x 2 block has one sign each
        rest = rest[np.ix_(others, others)] - side @ np.linalg.solve(block, side.T)
    return positive


def _isolated(matrix: np.ndarray, number: int, low: float, high: float, least: float) -> tuple[float, float]:
    """An interval around eigenvalue ``number`` (from 1, falling) without another, unless it gets as narrow as ``least``."""
    at_low, at_high = above(matrix, low), above(matrix, high)
    while (at_low > number or at_high < number - 1) and high - low > least:
        middle = (low + high) / 2
        count = above(matrix, middle)
        if count >= number:
            low, at_low = middle, count
        else:
            high, at_high = middle, count
    return low, high


def _without(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            vector = vector - other * (other @ vector)
    return vector / np.linalg.norm(vector)


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    """One step of inverse iteration; a shift that is an eigenvalue is moved by a rounding error."""
    size = len(matrix)
    for nudge in (0.0, 1.0, -3.0, 9.0):
        try:
            step = np.linalg.solve(matrix - (shift + nudge * np.finfo(float).eps * scale) * np.eye(size), vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(step).all() and step.any():
            return step / np.linalg.norm(step)
    raise RuntimeError("no step of inverse iteration from this shift")


def leading(matrix: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """(eigenvalue, unit eigenvector) of the ``count`` largest positive eigenvalues, falling.

    Counts of eigenvalues above a shift halve an interval until it holds one alone;
    Rayleigh quotients from there converge cubically, and counts on both sides of the
    result certify its number. Eigenvalues that rounding does not tell apart share the
    invariant subspace: their vectors are kept orthogonal. Eigenvalues below rounding of
    the largest are taken as zero and left out.
    """
    size, found = len(matrix), []
    if not size or not np.abs(matrix).max():
        return []
    matrix = (matrix + matrix.T) / 2
    bound = np.abs(matrix).sum(axis=1).max() * 1.0625
    rounding = np.finfo(float).eps * bound * size
    random = np.random.default_rng(13)
    for number in range(1, min(count, size) + 1):
        if above(matrix, 8 * rounding) < number:
            break
        low, high = _isolated(matrix, number, 0.0, bound, 4 * rounding)
        others = [v for _, v in found]
        vector = _without(random.standard_normal(size), others)
        value = (low + high) / 2
        for step in range(200):
            vector = _without(_solved(matrix, value, vector, bound), others)
            product = matrix @ vector
            quotient = float(vector @ product)
            if np.linalg.norm(product - quotient * vector) <= 4 * rounding:
                if above(matrix, quotient + 8 * rounding) < number <= above(matrix, quotient - 8 * rounding):
                    break
                # a neighbour's vector: start again from a smaller interval around the right one
                for _ in range(4):
                    low, high = _halved(matrix, number, low, high)
                vector, value = _without(random.standard_normal(size), others), (low + high) / 2
            elif low <= quotient <= high and step:
                value = quotient
            else:
                low, high = _halved(matrix, number, low, high)
                value = (low + high) / 2
        else:
            raise RuntimeError(f"eigenvalue {number} did not converge")
        found.append((quotient, vector))
    return found


def _halved(matrix: np.ndarray, number: int, low: float, high: float) -> tuple[float, float]:
    middle = (low + high) / 2
    return (middle, high) if above(matrix, middle) >= number else (low, middle)
