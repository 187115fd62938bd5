"""Eigendecompositions kept up to date by rank-one updates.

A spectrum is (values ascending, vectors as columns) of a symmetric matrix. Adding z z^T
moves every eigenvalue up to a root of the secular equation 1 + sum z_j^2 / (d_j - x) = 0,
one root between each two old values. Entries that cannot move are deflated first: those
with no share in z, and all but one of a run of equal values, whose shares a reflection
gathers in one of them.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 100  # of the root finder; halving alone would end in fewer than this many

Spectrum = tuple[np.ndarray, np.ndarray]


def empty(dims: int) -> Spectrum:
    return np.zeros(dims), np.eye(dims)


def updated(spectrum: Spectrum, row: np.ndarray) -> Spectrum:
    """The spectrum of the matrix plus row row^T."""
    d, q = spectrum
    z = row @ q
    size = z @ z
    if size == 0 or len(d) == 0:
        return spectrum
    tol = 8 * EPS * max(np.abs(d).max(), size)
    q = q.copy()
    ends = np.append(np.flatnonzero(np.diff(d) > tol), len(d) - 1)
    start = 0
    for end in ends + 1:
        if end - start > 1:
            gather(z[start:end], q[:, start:end])
        start = end
    moving = np.abs(z) * np.sqrt(size) > tol
    if not moving.any():
        return spectrum
    values, basis = d.copy(), q.copy()
    values[moving], turn = secular(d[moving], z[moving])
    basis[:, moving] = q[:, moving] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def gather(z: np.ndarray, q: np.ndarray) -> None:
    """Reflect in place so that only the last entry of z, a run of equal eigenvalues, is not 0."""
    length = np.linalg.norm(z)
    if length == 0:
        return
    v = z.copy()
    v[-1] += length if v[-1] >= 0 else -length
    q -= np.outer(q @ v, v) * (2 / (v @ v))
    z[-1] = -length if z[-1] >= 0 else length
    z[:-1] = 0


def secular(d: np.ndarray, z: np.ndarray) -> Spectrum:
    """Eigenvalues and eigenvectors of diag(d) + z z^T for distinct ascending d and z without zeros."""
    n, zz = len(d), z * z
    upper = np.append(d[1:], d[-1] + zz.sum())
    width = upper - d
    below = np.tri(n, dtype=bool)  # poles at or below each root
    # Roots are distances from the nearer pole, so that differences keep all their digits.
    middle = d + width / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        f = 1 + (zz / (d - middle[:, None])).sum(1)
    left = f >= 0
    left[-1] = True
    near = np.where(left, d, np.append(d[1:], d[-1]))
    gap = d - near[:, None]
    low, high = np.where(left, 0, -width / 2), np.where(left, width / 2, 0)
    high[-1] = width[-1]
    x = (low + high) / 2
    first, second = np.diagonal(gap).copy(), np.append(gap[np.arange(n - 1), np.arange(1, n)], np.inf)
    for _ in range(ROUNDS):
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = 1 / (gap - x[:, None])
            terms = zz * rest
            f = 1 + terms.sum(1)
            high, low = np.where(f >= 0, x, high), np.where(f < 0, x, low)
            if (np.abs(f) <= 4 * EPS * n * (1 + np.abs(terms).sum(1))).all():
                break
            # Fit each side's poles by the nearest one, with its value and slope, and solve for the root.
            slopes = terms * rest
            a, b = first - x, second - x
            dl, dr = np.where(below, slopes, 0).sum(1), np.where(below, 0, slopes).sum(1)
            c = f - np.where(np.isfinite(b), a * dl + b * dr, a * dl)
            p = c * (a + b) + a * a * dl + b * b * dr
            r = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * r, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * r / (p + root))
            last = a + a * a * dl / c  # the last root has no pole above
            step = np.where(np.isfinite(b), step, last)
        new = x + step
        good = np.isfinite(new) & ((new > low) & (new < high) | (new == x))
        new = np.where(good, new, between(low, high))
        still = np.abs(new - x) <= 4 * EPS * np.abs(new)
        x = new
        if (still | (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
    # Entries of a vector that has exactly these roots, so that the eigenvectors are orthogonal.
    apart = x[:, None] - gap
    poles = d[:, None] - d
    np.fill_diagonal(poles, 1)
    ratio = apart.copy()
    ratio /= np.where(np.eye(n, dtype=bool), 1, poles)
    share = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z)
    with np.errstate(divide="ignore", invalid="ignore"):
        vectors = np.where(apart == 0, np.eye(n), share / -apart).T
    return near + x, vectors / np.linalg.norm(vectors, axis=0)


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Points inside brackets that do not span 0, halving digits rather than lengths; a pole lies at 0."""
    inner, outer = np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))
    return np.where(high > 0, 1, -1) * np.where(inner > 0, np.sqrt(inner) * np.sqrt(outer), outer / 1024)


def folded(spectrum: Spectrum, rows: np.ndarray) -> Spectrum:
    """The spectrum after rank-one updates by all rows.

    More rows than dimensions are first turned into as many rows of the same scatter.
    """
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for row in rows:
        spectrum = updated(spectrum, row)
    return spectrum


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the sum of two matrices, by an update for each eigenpair of the second."""
    values, vectors = b
    for value, vector in zip(values, vectors.T):
        if value > 0:
            a = updated(a, np.sqrt(value) * vector)
    return a
