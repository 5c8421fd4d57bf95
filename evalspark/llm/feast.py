"""Largest eigenpairs of a symmetric matrix by contour integration, one interval at a time.

The matrix has one row per dimension of the embeddings, so it is small beside any table; intervals
are independent of each other and can be solved in different tasks.
"""

from __future__ import annotations

import numpy as np

#: Points of the quadrature on the upper half of a contour.
POINTS = 8
#: Rounds of filtering before the basis is made larger.
ROUNDS = 12
#: How wide a gap has to be, as a part of the interval it ends.
CLEAR = 0.1


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= alpha
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x / norm
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie below the shift: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    below, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        below += pivot < 0
    return below


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(from, to, number of eigenvalues) of intervals with the `wanted` largest ones, from the top.

    Each gap of the spectrum that is wide beside the interval above ends it. So eigenvalues that lie
    close together, or are one, stay together, and there can be more than wanted.
    """
    n = len(diagonal)
    radius = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = float(min(diagonal - radius)), float(max(diagonal + radius))
    span = max(high - low, 1e-6 * max(abs(low), abs(high)), np.finfo(float).tiny)
    low, high = low - 0.01 * span, high + 0.01 * span
    width = 1e-7 * span

    def bracket(rank: int) -> tuple[float, float]:
        """Where the eigenvalue with `rank` larger ones is."""
        a, b = low, high
        while b - a > width and a < (middle := (a + b) / 2) < b:
            a, b = (middle, b) if n - inertia(diagonal, off, middle) > rank else (a, middle)
        return a, b

    found, first, done = [], bracket(0), 0
    last, above = first, np.inf  # the space above the interval's first eigenvalue
    for rank in range(1, n + 1):
        after = bracket(rank) if rank < n else (-np.inf, -np.inf)
        gap, extent = last[0] - after[1], first[1] - last[0]
        if gap > max(4 * width, CLEAR * extent):
            margin = min(gap / 2, above)
            margin = margin if np.isfinite(margin) else 0.1 * span
            found.append((last[0] - margin, first[1] + margin, rank - done))
            if rank >= wanted:
                break
            first, above, done = after, gap / 2, rank
        last = after
    return found


def solve(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in an interval, largest first.

    A filtered basis, the quadrature of the resolvent around the interval applied to it, takes the
    place of the last one until all Ritz pairs of the interval are exact to rounding. If that takes
    long, other eigenvalues are near, and a larger basis holds them as well.
    """
    n = len(matrix)
    scale, eps = np.abs(matrix).sum(axis=1).max(), np.finfo(float).eps
    size = min(n, 2 * count + 6)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(-0.5j * np.pi * (nodes - 1))
    shifted = [(centre + radius * turn) * np.eye(n) - matrix for turn in turns]
    while True:
        basis = np.linalg.qr(np.random.default_rng(n).standard_normal((n, size)))[0]
        last = np.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((n, size))
            for turn, weight, system in zip(turns, weights, shifted):
                filtered += 0.5 * weight * (radius * turn * np.linalg.solve(system, basis)).real
            basis = np.linalg.qr(filtered)[0]
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ small
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            if len(inside) != count:  # by the counts of inertia at the bounds, one is missed yet
                continue
            pairs = basis[:, inside]
            residual = np.linalg.norm(matrix @ pairs - pairs * values[inside], axis=0).max()
            if residual <= 4 * eps * scale or last <= residual <= 1e-13 * scale:
                return values[inside], pairs
            last = residual
        if size == n:
            raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found")
        size = min(n, 2 * size)
