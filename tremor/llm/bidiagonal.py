"""Singular values and right vectors of a small square matrix, by bidiagonal qd.

Householder reflections make the matrix upper bidiagonal; dqds finds the squares of its singular
values, each to high relative accuracy; twisted factorisations of the bidiagonal's Gram matrix, less
one such square, give its vectors, and the reflections turn these back.  Vectors whose values lie
close together are made orthogonal among themselves.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
# Neighbours that differ by less than this share of the larger one count as one cluster.
CLOSE = 1e-3
# Transforms for one value; far more than are ever needed.
TURNS = 400


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v with (I - 2 v v') x = (alpha, 0, ...), and alpha."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0
    alpha = -math.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal, and the right reflectors (the k-th acts on columns k+1 on)."""
    a = np.array(r, dtype=np.float64)
    d = len(a)
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, diagonal[k] = _reflector(a[k:, k])
        a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            w, above[k] = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            right.append(w)
    return diagonal, above, right


def turned_back(vectors: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Columns in the bidiagonal's coordinates, in those of the matrix."""
    out = vectors.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        out[k + 1:] -= 2.0 * np.outer(w, w @ out[k + 1:])
    return out


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential transform, and its d; nothing if the shift is above the smallest square."""
    n = len(q)
    nq, ne, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None
        ds[i] = d
        nq[i] = d + e[i]
        if nq[i] == 0.0:
            ne[i], d = 0.0, q[i + 1] - shift
            continue
        ratio = q[i + 1] / nq[i]
        ne[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0.0:
        return None
    ds[-1] = nq[-1] = d
    return nq, ne, ds


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal with squared entries q and e, falling."""
    found: list[float] = []
    waiting = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while waiting:
        q, e, moved = waiting.pop()
        for _ in range(TURNS * max(1, len(q))):
            if len(q) <= 1:
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))
                        or e[i] <= EPS * EPS * max(q[i], q[i + 1]) * EPS), None)
            if cut is not None:
                waiting.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:  # the smallest should come out at the end
                q, e = q[::-1], e[::-1]
            plain = _dqds_step(q, e, 0.0)
            ds = plain[2]
            least = min(ds)
            if least <= 0.0:
                q, e = plain[0], plain[1]
                continue
            # The smallest square lies between these two; halves between them are tried first.
            below = 1.0 / sum(1.0 / x for x in ds)
            for shift in (least * (1.0 - 1e-3), 0.5 * (below + least), below * (1.0 - 4 * EPS * len(q))):
                step = _dqds_step(q, e, shift)
                if step is not None:
                    q, e, moved = step[0], step[1], moved + shift
                    break
            else:
                q, e = plain[0], plain[1]
        found += [x + moved for x in q]
    return np.sort(np.array(found))[::-1]


def twisted(q: np.ndarray, e: np.ndarray, off: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit eigenvector of the Gram matrix (``off`` holds its off-diagonal) near a value, and a better value."""
    n = len(q)
    if n == 1:
        return np.ones(1), float(q[0])
    tiny = np.finfo(np.float64).tiny / EPS
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = s[i] + q[i] or tiny
        down[i] = off[i] / pivot
        s[i + 1] = e[i] * s[i] / pivot - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1] or tiny
        up[i] = off[i] / pivot
        p[i] = p[i + 1] * q[i] / pivot - value
    gamma = s + p + value
    k = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(z @ z)
    return z / math.sqrt(size), value + float(gamma[k]) / size


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the right vectors as columns (zeros for squares that are nothing but rounding)."""
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(r)), np.eye(len(r))
    diagonal, above, right = bidiagonalise(r / scale)
    q, e, off = diagonal ** 2, above ** 2, diagonal[:-1] * above
    values = dqds(q, e)
    columns = np.zeros((len(r), len(r)))
    first = 0
    for k, value in enumerate(values):
        if value <= EPS * len(r) * values[0]:
            break  # nothing but rounding: no direction is told for it
        z, better = twisted(q, e, off, value)
        if abs(better - value) <= 1e-6 * value:
            z, _ = twisted(q, e, off, better)
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            first = k
        for _ in range(2):
            z = z - columns[:, first:k] @ (columns[:, first:k].T @ z)
            length = np.linalg.norm(z)
            if not length > 1e-3:  # one value many times over: any direction left in its space will do
                z = _left_over(columns[:, first:k], q, e, off, value)
                continue
            z = z / length
        columns[:, k] = z
    return values * scale ** 2, turned_back(columns, right)


def _left_over(known: np.ndarray, q: np.ndarray, e: np.ndarray, off: np.ndarray, value: float) -> np.ndarray:
    """A direction of a repeated value's space outside the known ones: inverse iteration from fixed starts."""
    n = len(q)
    gram = np.diag(q + np.append(0.0, e)) + np.diag(off, 1) + np.diag(off, -1)
    shifted = gram - value * (1 + 1e-13) * np.eye(n)
    z = np.cos(np.arange(1, n + 1) * (known.shape[1] + 1.0))
    for _ in range(4):
        z = z - known @ (known.T @ z)
        z = z / np.linalg.norm(z)
        try:
            z = np.linalg.solve(shifted, z)
        except np.linalg.LinAlgError:  # the shift is a value to the last bit: turn it a little
            z = np.linalg.solve(shifted + 1e-14 * value * np.eye(n), z)
    z = z - known @ (known.T @ z)
    return z / np.linalg.norm(z)
