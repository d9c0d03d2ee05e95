"""Vectors for tests and benchmarks, made in the executors from their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def adversarial(spark: SparkSession, n: int, dim: int, seed: int = 42, blobs: int = 10, share: float = 0.3, spread: float = 0.4) -> DataFrame:
    """``vec_id, embedding``: unit vectors, a ``share`` of them in blobs around a few centres, the others Gaussian. The same for the same seed."""
    centres = np.random.default_rng(seed).standard_normal((blobs, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            x = np.empty((len(ids), dim))
            for r, i in enumerate(ids):
                g = np.random.default_rng([seed, int(i)])
                x[r] = centres[g.integers(blobs)] + spread * g.standard_normal(dim) if g.random() < share else g.standard_normal(dim)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            off = np.arange(len(ids) + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(x.astype(np.float32).ravel()))], ["vec_id", "embedding"])

    return spark.range(n).select("id").withColumnRenamed("id", "vec_id").mapInArrow(run, "vec_id bigint, embedding array<float>")
