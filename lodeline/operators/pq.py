"""Product quantisation: codebooks per sub-space, one code per sub-vector, scores from a table per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.kernels import matrix
from lodeline.functions.vectors import cosine_score
from lodeline.operators.exact import batch_topk, ranked
from lodeline.operators.kmeans import first_vectors, nearest_cosine, spherical

CODES = 256


def sub_spaces(dim: int) -> int:
    """How many sub-spaces a dimension is cut into: of 8 elements, or of 4; then ``dim`` must be a multiple of it."""
    m = dim // 8 if dim % 8 == 0 else max(1, dim // 4)
    if dim % m:
        raise ValueError(f"dimension {dim} can't be cut into {m} sub-spaces")
    return m


def auto_tune(dim: int) -> tuple[int, int]:
    """(sub-spaces, elements of each) as a configuration suggests them."""
    m = min(256, max(16, dim // 8))
    return m, dim // m


def start_codebooks(vectors: DataFrame, m: int, codes: int = CODES) -> np.ndarray:
    """Directions of the sub-vectors of the lowest ids."""
    x = first_vectors(vectors, codes)
    if not len(x):
        raise ValueError("training needs at least one vector")
    x = x[np.arange(codes) % len(x)]
    c = x.reshape(codes, m, x.shape[1] // m).transpose(1, 0, 2)
    n = np.sqrt((c * c).sum(2, keepdims=True))
    return np.where(n > 1e-10, c / np.where(n > 1e-10, n, 1), c)


def validate(dim: int, m: int, codes: int = CODES) -> None:
    """Raise ValueError for a configuration that can't be: sub-spaces that don't divide the dimension, codes that don't fit into a byte."""
    if m < 1 or dim % m:
        raise ValueError(f"dimension {dim} can't be cut into {m} sub-spaces")
    if not 1 <= codes <= 256:
        raise ValueError(f"{codes} codes aren't within 1..256")


def train(vectors: DataFrame, m: int, codes: int = CODES, iterations: int = 20) -> np.ndarray:
    """Codebooks (sub-space, code, element), by spherical k-means. vectors: ``vec_id, embedding``."""
    dim = vectors.where("embedding is not null").agg(F.max(F.size("embedding"))).first()[0]
    if dim is not None:
        validate(dim, m, codes)
    return spherical(vectors, start_codebooks(vectors, m, codes), iterations)


def codebook_rows(spark, c: np.ndarray) -> DataFrame:
    """``m, code, j, cx``."""
    m, k, j = (x.ravel().tolist() for x in np.indices(c.shape))
    return spark.createDataFrame(list(zip(m, k, j, c.ravel().tolist())), "m int, code int, j int, cx double")


def codebook_matrix(rows: DataFrame) -> np.ndarray:
    """Codebooks of ``m, code, j, cx``; repeated rows count once, missing elements are 0."""
    r = rows.where("m >= 0 and code >= 0 and j >= 0").groupBy("m", "code", "j").agg(F.max("cx").alias("cx")).toPandas()
    c = np.zeros(tuple(int(r[x].max()) + 1 if len(r) else 0 for x in ("m", "code", "j")))
    if len(r):
        c[r["m"], r["code"], r["j"]] = r["cx"].fillna(0)
    return c


def encode(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """``vec_id, codes`` (array<smallint>): the code of highest cosine in each sub-space (ties: the highest code; a zero sub-vector: 0). Null and
    ragged vectors are left out. A projection in Arrow batches; the codebooks' size doesn't depend on the data."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        w = c.shape[2]
        for b in batches:
            x, at = matrix(b.column(1), len(c) * w)
            codes = np.stack([nearest_cosine(x[:, m * w : (m + 1) * w], c[m]) for m in range(len(c))], 1).astype(np.int16)
            off = np.arange(len(x) + 1, dtype=np.int32) * len(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(off), pa.array(codes.ravel()))], ["vec_id", "codes"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, codes array<smallint>")


def distance_table(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(query, sub-space, code): cosine of each sub-vector to each code (codes of norm 1), 0 for a zero sub-vector."""
    x = q.reshape(len(q), c.shape[0], c.shape[2])
    n = np.sqrt((x * x).sum(2))
    return np.einsum("qmj,mkj->qmk", x, c) / np.where(n > 1e-10, n, 1)[..., None] * (n > 1e-10)[..., None]


def search(codes: DataFrame, c: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """As ``batch_topk``, by the mean over the sub-spaces of the table's entries: a table per query, a lookup per code."""

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        t, at = distance_table(q, c), x.astype(np.int64)
        s = np.zeros((len(q), len(x)))
        for m in range(len(c)):
            s += t[:, m, at[:, m]]
        return s / len(c)

    return batch_topk(codes.select("vec_id", F.col("codes").alias("embedding")), queries, k, decode=lambda x: x, scores=scores)


def table_scores(c: np.ndarray):
    """For a graph's search over codes: of a query, whose table is made once, a function of stored codes that gives their scores."""

    def prepare(q: np.ndarray):
        t, at = distance_table(q[None], c)[0], np.arange(len(c))
        return lambda codes: t[at, codes.astype(np.int64)].mean(1)

    return prepare


def search_reranked(codes: DataFrame, c: np.ndarray, vectors: DataFrame, queries: DataFrame, k: int, longer: int = 20) -> DataFrame:
    """As ``batch_topk``: the k best by the exact score among the k x ``longer`` best by the codes. Only those are joined to their vectors."""
    found = search(codes, c, queries, k * longer).select("qid", "vec_id")
    d = found.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("qid", "q"), "qid")
    return ranked(d.select("qid", "vec_id", cosine_score(F.col("embedding"), F.col("q")).alias("s")), k)


def stats(n: int, m: int, sub_dim: int) -> dict[str, float]:
    memory, full = n * m, n * m * sub_dim * 4
    return {"vector_count": n, "memory_bytes": memory, "full_precision_bytes": full, "compression_ratio": full / max(memory, 1)}
