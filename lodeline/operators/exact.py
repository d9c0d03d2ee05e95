"""Exact search: the k best vectors of each query over the whole collection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import vectors as V
from lodeline.functions.kernels import METRICS, TopK, matrix

#: Bytes of queries that go to all executors at once; more queries go in more passes.
SLICE_BYTES = 32 << 20
SCHEMA = "qid bigint, vec_id bigint, s double"


def topk(collection: DataFrame, query: list[float], k: int, score: Callable[[Column, Column], Column] = V.cosine_score) -> DataFrame:
    """``vec_id, score`` of the k vectors nearest to one query, best first, ties by vec_id; k above the number of rows gives all, k < 1
    none. JVM-side; each task keeps k rows. collection: ``vec_id, embedding``; null vectors have no score and are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = collection.select("vec_id", score(F.col("embedding"), q).alias("score")).where(F.col("score").isNotNull())
    return d.orderBy(F.round("score", 9).desc(), "vec_id").limit(max(k, 0))


def ranked(local: DataFrame, k: int) -> DataFrame:
    """``qid, vec_id, rk, score``: the k best of the tasks' lists, scores compared at 9 decimals."""
    w = Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "vec_id")
    return local.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("qid", "vec_id", "rk", F.col("s").alias("score"))


def query_slices(queries: DataFrame, dim_bytes: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, in slices of a bounded size. Null or ragged vectors are no queries."""
    q = queries.where("qid is not null and size(q) > 0").select("qid", "q")
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not n:
        return
    parts = max(1, math.ceil(n * width * 8 / dim_bytes))
    for p in range(parts):
        t = q.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).toArrow()
        x, at = matrix(t["q"], width)
        if len(at):
            yield t["qid"].to_numpy()[at], x


def batch_topk(collection: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", decode: Callable[[np.ndarray], np.ndarray] | None = None, scores: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``qid, vec_id, rk, score``: for each query its k best vectors, scores compared at 9 decimals, ties by vec_id.

    collection: ``vec_id, embedding``; queries: ``qid, q``. Rows that are null or of another dimension than the query take no part; no
    queries or no rows give none. The collection stays where it is: queries go to it in slices of a bounded size, each task scores its
    batches as matrix products and keeps k rows per query, which are merged by query. ``decode`` turns stored rows into vectors,
    ``scores`` replaces the metric's score matrix."""
    spark = collection.sparkSession
    score = scores or METRICS[metric]
    base = collection.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    out = None
    for ids, q in query_slices(queries) if k > 0 else ():
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = TopK(len(ids), k)
            for b in batches:
                x, at = matrix(b.column(1), None if decode else q.shape[1])
                own = b.column(0).to_numpy()[at]
                for s in range(0, len(own), step := max(1, (1 << 22) // max(1, len(ids)))):
                    rows = x[s : s + step]
                    best.add(score(q, decode(rows) if decode else rows), own[s : s + step])
            i, v, s = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(v), pa.array(s)], ["qid", "vec_id", "s"])

        local = base.mapInArrow(run, SCHEMA)
        out = local if out is None else out.union(local)
    return ranked(out if out is not None else spark.createDataFrame([], SCHEMA), k)


def with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """``results`` with ``metadata``, null where there is none: looked up for the winners only. metadata: ``vec_id, metadata``."""
    return results.join(metadata.select("vec_id", "metadata"), "vec_id", "left")


def with_external_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    """``results`` with ``ext_id``; rows without one are dropped. ids: ``vec_id, ext_id``."""
    return results.join(ids.select("vec_id", "ext_id"), "vec_id")
