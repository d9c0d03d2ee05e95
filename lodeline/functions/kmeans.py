"""Lloyd's algorithm on an array in memory, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sq_dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of c, not below 0."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return np.maximum(d, 0, out=d)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) of each row, in blocks of bounded size."""
    step = max(1, block // max(1, len(c)))
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), step):
        e = sq_dist(x[s : s + step], c)
        at[s : s + step] = i = e.argmin(1)
        d[s : s + step] = e[np.arange(len(i)), i]
    return at, d


def seed_far(x: np.ndarray, k: int, rng: np.random.Generator, block: int = 16) -> np.ndarray:
    """k rows of x, drawn in blocks with a probability that grows with the distance to those drawn before."""
    if len(x) <= k:
        return x[np.arange(k) % len(x)].copy()
    chosen = [int(rng.integers(len(x)))]
    d = sq_dist(x, x[chosen])[:, 0]
    while len(chosen) < k:
        n = min(block, k - len(chosen))
        total = d.sum()
        p = d / total if total > 0 else np.full(len(x), 1 / len(x))
        new = rng.choice(len(x), n, p=p)
        chosen += new.tolist()
        d = np.minimum(d, sq_dist(x, x[new]).min(1))
    return x[chosen].copy()


def lloyd(x: np.ndarray, k: int, iterations: int = 10, seed: int = 0) -> np.ndarray:
    """k centroids of the rows of x (not empty). A centroid that loses all its rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = seed_far(x, k, rng)
    for _ in range(iterations):
        near, d = nearest(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        full = n > 0
        new = c.copy()
        new[full] = s[full] / n[full, None]
        if (~full).any():
            far = np.argsort(-d, kind="stable")[: (~full).sum()]
            new[np.flatnonzero(~full)[: len(far)]] = x[far]
        if np.array_equal(new, c):
            break
        c = new
    return c
