"""Distributed k-means: Lloyd's algorithm, and its spherical form for product quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.kernels import matrix
from lodeline.functions.kmeans import sq_dist


def first_vectors(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k lowest ids: a start that depends on nothing else. Fewer rows give fewer centroids."""
    t = vectors.where("vec_id is not null and embedding is not null").orderBy("vec_id").limit(k).select("embedding").toArrow()
    return matrix(t["embedding"])[0]


def nearest_l2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return sq_dist(x, c).argmin(1)


def nearest_cosine(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By cosine; the highest number wins ties; a zero centroid counts as -1, a zero vector goes to 0."""
    nx, nc = np.sqrt((x * x).sum(1)), np.sqrt((c * c).sum(1))
    s = np.where(nc > 1e-10, x @ c.T / np.where(nx > 1e-10, nx, 1)[:, None] / np.where(nc > 1e-10, nc, 1), -1).round(12)
    near = s.shape[1] - 1 - s[:, ::-1].argmax(1)
    return np.where(nx > 1e-10, near, 0)


def _sums(vectors: DataFrame, c: np.ndarray, nearest, subs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows nearest to each centroid, for each sub-space. A task sends a row per centroid that it met."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)
    width = c.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        s, n = np.zeros_like(c), np.zeros(c.shape[:2], np.int64)
        for b in batches:
            x, _ = matrix(b.column(0), subs * width)
            for m in range(subs):
                y = x[:, m * width : (m + 1) * width]
                near = nearest(y, c[m])
                np.add.at(s[m], near, y)
                n[m] += np.bincount(near, minlength=c.shape[1])
        m, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(k, pa.int32()), pa.array(n[m, k]), pa.array([r.tobytes() for r in s[m, k]], pa.binary())], ["m", "k", "n", "s"])

    def add(t: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(t["s"].to_pylist())).reshape(-1, width).sum(0)
        return pa.table({"m": t["m"].slice(0, 1), "k": t["k"].slice(0, 1), "n": pa.array([int(t["n"].to_numpy().sum())]), "s": pa.array([s.tobytes()], pa.binary())})

    out = "m int, k int, n bigint, s binary"
    total = vectors.select("embedding").mapInArrow(run, out).groupBy("m", "k").applyInArrow(add, out).toArrow()
    s, n = np.zeros_like(c), np.zeros(c.shape[:2], np.int64)
    m, k = total["m"].to_numpy(), total["k"].to_numpy()
    n[m, k] = total["n"].to_numpy()
    if len(m):
        s[m, k] = np.frombuffer(b"".join(total["s"].to_pylist())).reshape(-1, width)
    return s, n


def lloyd(vectors: DataFrame, start: np.ndarray, iterations: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Centroids by squared L2, from ``start``: at most ``iterations`` passes, ended when the squared shifts sum to less than ``tolerance``. A
    centroid without rows stays where it is. vectors: ``vec_id, embedding``; null, ragged and null-holding ones take no part."""
    c = start[None]
    for _ in range(iterations if len(start) else 0):
        s, n = _sums(vectors, c, nearest_l2, 1)
        new = np.where(n[..., None] > 0, s / np.maximum(n, 1)[..., None], c)
        moved = ((new - c) ** 2).sum()
        c = new
        if moved < tolerance:
            break
    return c[0]


def spherical(vectors: DataFrame, start: np.ndarray, iterations: int = 20) -> np.ndarray:
    """Codebooks (sub-space, code, element) of norm 1: rows go to the code of highest cosine, codes move to the direction of their mean.
    Ends when no code moves more than 1e-6; a code without rows stays."""
    c = start
    for _ in range(iterations):
        s, n = _sums(vectors, c, nearest_cosine, len(c))
        mean = s / np.maximum(n, 1)[..., None]
        size = np.sqrt((mean * mean).sum(2, keepdims=True))
        new = np.where((n[..., None] > 0), mean / np.where(size > 1e-10, size, 1), c)
        moved = np.sqrt(((new - c) ** 2).sum(2)).max()
        c = new
        if moved <= 1e-6:
            break
    return c


def centroid_rows(spark, c: np.ndarray) -> DataFrame:
    """``cid, pos, cx``."""
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(c) for j, x in enumerate(row)], "cid int, pos int, cx double")


def centroid_matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cids, matrix) of ``cid, pos, cx``. Repeated rows count once; centroids with a missing or null element are left out."""
    r = rows.where("cid is not null and pos is not null").groupBy("cid", "pos").agg(F.max("cx").alias("cx")).orderBy("cid", "pos").toPandas()
    if not len(r):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    t = r.pivot(index="cid", columns="pos", values="cx").dropna()
    return t.index.to_numpy(), t.to_numpy()
