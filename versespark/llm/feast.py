"""Eigenvectors of a symmetric matrix by contour integration, checked by inertia counts.

The greatest eigenvalues are first located: the matrix is brought to tridiagonal form, whose Sturm sequences count the
eigenvalues below any number, and bisection on these counts brackets each. Brackets are cut into intervals of few
eigenvalues at their widest gaps. For each interval the spectral projector is applied to random vectors, as a quadrature
over a circle through the interval's ends of solves with the complex shifted matrix; Rayleigh-Ritz in the projected
subspace gives the eigenpairs, and both are repeated until residuals are as small as rounding allows. An interval counts
as done only if it gives as many eigenvalues as its inertia count says; else its subspace grows. Last, one Rayleigh-Ritz
step over all intervals makes the vectors orthonormal as a whole.

The matrix has as many rows as vectors have dimensions, so this is work for the driver.
"""

from __future__ import annotations

import numpy as np

#: Nodes of the quadrature on a half circle, eigenvalues of an interval, steps at most.
NODES, PER_INTERVAL, STEPS = 12, 8, 60
EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the off-diagonal of a tridiagonal matrix with the eigenvalues of `a` (Householder reflections)."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) == 0.0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(t: tuple[np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each point: negative pivots of the shifted tridiagonal matrix (inertia)."""
    d, e = t
    tiny = EPS * (np.abs(d).max(initial=0.0) + np.abs(e).max(initial=0.0)) + np.finfo(float).tiny
    n = np.zeros(len(points), int)
    q = np.full(len(points), np.inf)
    for k in range(len(d)):
        q = d[k] - points - (e[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def brackets(t: tuple[np.ndarray, np.ndarray], k: int, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the k greatest eigenvalues, the greatest first."""
    d, e = t
    n, out = len(d), np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = np.full(k, (d - out).min()), np.full(k, (d + out).max())
    slack = EPS * n * max(np.abs(low[0]), np.abs(high[0]))
    low, high = low - slack, high + slack
    place = n - 1 - np.arange(k)
    for _ in range(steps):
        mid = (low + high) / 2
        under = below(t, mid) <= place  # fewer eigenvalues are below: this one isn't
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low, high


def intervals(t: tuple[np.ndarray, np.ndarray], k: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, inertia count) that together hold the k greatest eigenvalues, from above. They are cut
    at the widest gaps; eigenvalues that can't be told apart stay together, so an interval may hold more than `per`, and the
    last one more than is asked for."""
    n = len(t[0])
    low, high = brackets(t, min(n, k + per))
    value, scale = (low + high) / 2, max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    same = 64 * n * EPS * scale
    gap = value[:-1] - value[1:]
    last = next((j for j in range(k - 1, len(gap)) if gap[j] > same), len(value) - 1)
    if last == len(value) - 1 and len(value) < n:
        return intervals(t, len(value), per)
    ends, at = [], 0
    while at <= last:  # [at, end] becomes an interval: the widest gap among the next ones ends it
        most = min(at + per - 1, last)
        end = last if most == last else at + int(np.argmax(gap[at : most + 1]))
        while end < last and gap[end] <= same:
            end += 1
        ends.append((at, end))
        at = end + 1
    margin = lambda j: min(gap[j] / 2, 0.05 * scale)
    out = []
    for a, b in ends:
        upper = value[a] + (margin(a - 1) if a else 0.05 * scale)
        lower = value[b] - (margin(b) if b < len(gap) else 0.05 * scale)
        m, p = below(t, np.array([lower, upper]))
        out.append((lower, upper, int(p - m)))
    return out


def projected(a: np.ndarray, y: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """The spectral projector of [low, high] applied to y: Gauss-Legendre quadrature over the upper half of a circle; the
    lower half is its conjugate."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for theta, weight in zip(np.pi / 2 * (1 - x), w, strict=True):
        turn = np.exp(1j * theta)
        solved = np.linalg.solve((middle + radius * turn) * np.eye(len(a)) - a, y)
        out += weight / 2 * (radius * turn * solved).real
    return out


def rayleigh_ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of `a` within the span of q, the greatest first."""
    q, _ = np.linalg.qr(q)
    small = q.T @ a @ q
    e, u = np.linalg.eigh((small + small.T) / 2)
    return e[::-1], q @ u[:, ::-1]


def in_interval(a: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in (low, high)."""
    n, size = len(a), min(len(a), count + max(4, count // 2))
    rng = np.random.default_rng(seed)
    scale = np.linalg.norm(a, np.inf)
    while True:
        x, best = rng.standard_normal((n, size)), np.inf
        for _ in range(STEPS):
            e, x = rayleigh_ritz(a, projected(a, x, low, high))
            inside = (e > low) & (e < high)
            v = x[:, inside]
            residual = np.linalg.norm(a @ v - v * e[inside], axis=0).max(initial=0.0) / max(scale, np.finfo(float).tiny)
            if inside.sum() == count and (residual < 8 * EPS * n or (residual < 1e-11 and residual > best / 2)):
                return e[inside], v
            best = min(best, residual) if inside.sum() == count else np.inf
        if size == n:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but {int(inside.sum())} were found")
        size = min(n, 2 * size)


def greatest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    k = min(k, len(a))
    scale = np.abs(a).max(initial=0.0)
    if not k or scale == 0.0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    a = (a + a.T) / (2 * scale)
    found = [in_interval(a, low, high, count) for low, high, count in intervals(tridiagonal(a), k)]
    e, v = rayleigh_ritz(a, np.concatenate([v for _, v in found], axis=1))
    return e[:k] * scale, v[:, :k]
