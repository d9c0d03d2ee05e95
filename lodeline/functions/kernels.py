"""Score matrices in NumPy for Arrow batches. All scores are higher for better."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TINY = 1e-10


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``dim`` elements in double, positions of those rows). Rows that are null, of another length or hold a null are left out."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.list_value_length(c).fill_null(-1))
    if dim is None:
        dim = int(size.max()) if len(size) else 0
    at = np.flatnonzero(size == dim)
    flat = c.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    if flat.null_count:
        keep = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), dim).any(1)
        x, at = x[keep], at[keep]
    return x, at


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(1 + cosine) / 2 with the zero-vector cases of ``cosine_score``."""
    nq, nx = norms(q), norms(x)
    s = q @ x.T
    s /= np.where(nq == 0, 1, nq)[:, None]  # in place: fresh memory for each step would take longer than the step
    s /= np.where(nx == 0, 1, nx)
    s += 1
    s /= 2
    zq, zx = nq == 0, nx == 0
    if zq.any() or zx.any():
        s[zq[:, None] ^ zx[None, :]] = 0.5
        s[zq[:, None] & zx[None, :]] = 1.0
    return s


def raw(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    nq, nx = norms(q), norms(x)
    s = q @ x.T / np.where(nq > TINY, nq, 1)[:, None] / np.where(nx > TINY, nx, 1)
    s[nq <= TINY] = 0
    s[:, nx <= TINY] = 0
    return s


def minus_sq_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return -np.maximum((q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1), 0)


METRICS = {"cosine": cosine, "raw": raw, "sq_l2": minus_sq_l2}


class TopK:
    """The k best of each query over batches: scores compared at 9 decimals, ties by smaller id. They are kept as they are: rounded twice, some would differ in a later digit."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.s = np.full((queries, k), -np.inf)
        self.i = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, s: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """s: queries x items, NaN for no item. of: the queries, if not all."""
        of = np.arange(len(s)) if of is None else of
        some, few, who = np.arange(len(s)), s, np.broadcast_to(ids, s.shape)
        if s.shape[1] > 4 * self.k > 0:  # those below the k-th best, of before or of these, can't matter; ties with it stay
            least = self.s[of, -1]
            if len(new := np.flatnonzero(least == -np.inf)):
                own = np.where(np.isnan(s[new]), -np.inf, s[new])
                least[new] = np.partition(own, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            at = s >= (least - 2e-9)[:, None]  # beyond what 9 decimals tell apart
            many = at.sum(1)
            row, col = np.nonzero(at)
            few, who = np.full((len(s), many.max(initial=0)), -np.inf), np.full((len(s), many.max(initial=0)), np.iinfo(np.int64).max)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            few[row, place], who[row, place] = s[row, col], ids[col]
            some = np.flatnonzero(many)
        few = np.where(np.isnan(few[some]), -np.inf, few[some])
        s, i = np.hstack([self.s[of[some]], few]), np.hstack([self.i[of[some]], who[some]])
        o = np.lexsort((i, -s.round(9)), axis=-1)[:, : self.k]
        self.s[of[some]], self.i[of[some]] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.repeat(np.arange(len(self.s)), self.s.shape[1])
        s, i = self.s.ravel(), self.i.ravel()
        ok = s > -np.inf
        return q[ok], i[ok], s[ok]
