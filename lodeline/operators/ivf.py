"""Inverted file: vectors in the cell of their nearest centroid, queries in the cells nearest to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.kernels import TopK, cosine, matrix
from lodeline.operators.exact import SCHEMA, query_slices, ranked


def assign(vectors: DataFrame, cids: np.ndarray, c: np.ndarray, nprobe: int = 1, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, cid, rk, score``: the ``nprobe`` centroids of highest cosine score for each vector (ties: smallest cid). Null and ragged vectors are
    left out; no centroids give no rows. A projection in Arrow batches."""
    n = min(nprobe, len(cids))
    shared = vectors.sparkSession.sparkContext.broadcast((cids, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, c = shared.value
        for b in batches:
            x, at = matrix(b.column(1), c.shape[1] if len(c) else 0)
            s = cosine(x, c).round(12) if n else np.zeros((len(x), 0))
            o = np.lexsort((np.broadcast_to(cids, s.shape), -s), axis=-1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(at, n))), pa.array(cids[o].ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x))), pa.array(np.take_along_axis(s, o, 1).ravel())],
                [key, "cid", "rk", "score"],
            )

    return vectors.select(key, vector).mapInArrow(run, f"{key} bigint, cid int, rk int, score double")


def with_cell(vectors: DataFrame, cids: np.ndarray, c: np.ndarray) -> DataFrame:
    """``cid, vec_id, embedding``: to be written partitioned by cid. A projection in Arrow batches."""
    shared = vectors.sparkSession.sparkContext.broadcast((cids, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, c = shared.value
        for b in batches:
            x, at = matrix(b.column(1), c.shape[1] if len(c) else 0)
            s = cosine(x, c).round(12) if len(c) else np.zeros((0, 1))
            near = np.lexsort((np.broadcast_to(cids, s.shape), -s), axis=-1)[:, 0] if len(c) else np.zeros(0, np.int64)
            keep = pa.array(at[: len(near)])
            yield pa.RecordBatch.from_arrays([pa.array(cids[near].astype(np.int32)), b.column(0).take(keep), b.column(1).take(keep)], ["cid", "vec_id", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"cid int, vec_id bigint, embedding {kind}")


def search(cells: DataFrame, cids: np.ndarray, c: np.ndarray, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """``qid, vec_id, rk, score`` as ``batch_topk``, over the members of the ``nprobe`` cells nearest to each query. cells: ``cid, vec_id, embedding``.

    The members stay where they are stored: only cells that some query probes are read (a filter on cid, which prunes a table that is partitioned by it), queries go to
    them in slices of a bounded size, and a task scores the members of a cell with the queries that probe it and keeps k rows per query. A cell of any size is as many
    tasks as it has splits."""
    spark = cells.sparkSession
    out = None
    n = min(nprobe, len(cids))
    for ids, q in query_slices(queries) if k > 0 and n > 0 else ():
        near = np.lexsort((np.broadcast_to(cids, (len(q), len(cids))), -cosine(q, c).round(12)), axis=-1)[:, :n]
        of_cell = {int(cids[j]): np.flatnonzero((near == j).any(1)) for j in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, q, of_cell))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, of_cell = shared.value
            best = TopK(len(ids), k)
            for b in batches:
                x, at = matrix(b.column("embedding"), q.shape[1])
                own, cid = b.column("vec_id").to_numpy()[at], b.column("cid").to_numpy()[at]
                for one in np.unique(cid).tolist():
                    rows, who = np.flatnonzero(cid == one), of_cell.get(one, np.zeros(0, np.int64))
                    for s in range(0, len(who), step := max(1, (1 << 22) // max(1, len(rows)))):
                        best.add(cosine(q[who[s : s + step]], x[rows]), own[rows], who[s : s + step])
            i, v, s = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(v), pa.array(s)], ["qid", "vec_id", "s"])

        local = cells.where(F.col("cid").isin(sorted(of_cell))).select("cid", "vec_id", "embedding").mapInArrow(run, SCHEMA)
        out = local if out is None else out.union(local)
    return ranked(out if out is not None else spark.createDataFrame([], SCHEMA), k)
