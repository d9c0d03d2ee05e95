"""Per-key results when a few keys hold most rows (problem 3): two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.kernels import matrix

#: A key with at least this share of all rows is heavy, so there are at most 100 of them.
HEAVY_SHARE = 0.01
SALTS = 32

#: How the partial results of an aggregate are merged.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def key_counts(df: DataFrame, key: str, spread: list[str], salts: int = SALTS) -> DataFrame:
    """``key, n``: rows of each key (null is a key), counted per salt first."""
    salted = df.select(key, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int").alias("__salt"))
    return salted.groupBy(key, "__salt").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("n"))


def heavy_keys(df: DataFrame, key: str, spread: list[str], share: float = HEAVY_SHARE) -> list:
    """The keys with at least ``share`` of all rows, most rows first; at most 1 / share of them. Null is never one."""
    total = df.count()
    return [r[0] for r in key_counts(df.where(F.col(key).isNotNull()), key, spread).where(F.col("n") >= share * total).orderBy(F.desc("n"), key).collect()]


def salted(df: DataFrame, key: str, heavy: list, spread: list[str], salts: int = SALTS, name: str = "__salt") -> DataFrame:
    """``df`` with a salt: 0 for a light key, 0..salts-1 for a heavy one. It comes from a hash of ``spread``, not from a random
    number, so that a task that runs again gives the same rows."""
    is_heavy = reduce(lambda a, b: a | b, (F.col(key).eqNullSafe(F.lit(k)) for k in heavy), F.lit(False))
    return df.withColumn(name, F.when(is_heavy, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))


def salted_aggregate(df: DataFrame, key: str, aggs: dict[str, tuple[str, Column]], spread: list[str], also: tuple[str, ...] = (), share: float = HEAVY_SHARE, salts: int = SALTS, heavy: list | None = None) -> DataFrame:
    """Aggregates per ``key`` (and the columns ``also``) in two stages: by key and salt, then by key.

    aggs: result name -> (one of count, sum, min, max, mean; column). ``spread``: columns whose hash salts the heavy keys; they should
    tell the rows of a key apart. Null keys form a group of their own; an empty table gives no rows; null values are ignored as
    Spark's aggregates do. Nothing is dropped: heavy keys only get more tasks. The first stage combines on the map side, so a
    reducer sees at most salts x map tasks rows of a key."""
    if heavy is None:
        heavy = heavy_keys(df, key, spread, share)
    by = [key, *also]
    first, last, shown = [], [], []
    for name, (kind, c) in aggs.items():
        parts = {"mean": ("sum", "count")}.get(kind, (kind,))
        for p in parts:
            first.append(getattr(F, p)(c).alias(f"__{name}_{p}"))
            last.append(_MERGE[p](f"__{name}_{p}").alias(f"__{name}_{p}"))
        shown.append((F.try_divide(F.col(f"__{name}_sum"), F.col(f"__{name}_count")) if kind == "mean" else F.col(f"__{name}_{kind}")).alias(name))
    return salted(df, key, heavy, spread, salts).groupBy(*by, "__salt").agg(*first).groupBy(*by).agg(*last).select(*by, *shown)


def partition_sizes(assignment: DataFrame) -> DataFrame:
    """``cid, n_rows, share``: rows of each partition, and its share of all rows of the log (those of no partition too)."""
    total = assignment.count()
    n = salted_aggregate(assignment.where("cid >= 0"), "cid", {"n_rows": ("count", F.lit(1))}, ["vec_id", "assigned_at"])
    return n.withColumn("share", F.try_divide(F.col("n_rows").cast("double"), F.lit(float(total))))


def partition_members(assignment: DataFrame) -> DataFrame:
    """Distinct ``cid, vec_id`` of the log, without null ids and rows of no partition."""
    return assignment.where("cid >= 0 and vec_id is not null").select("cid", "vec_id").distinct()


def partition_means(assignment: DataFrame, vectors: DataFrame) -> DataFrame:
    """``cid, pos, mean, n_vectors``: the mean vector of each partition over its distinct usable vectors (``vectors`` as given by
    ``usable``), one row per element; a partition without any has no rows."""
    m = partition_members(assignment).join(vectors.select("vec_id", "embedding"), "vec_id")
    heavy = heavy_keys(assignment.where("cid >= 0"), "cid", ["vec_id", "assigned_at"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each partition and salt of a batch: the sum of its vectors, as bytes."""
        for b in batches:
            x, at = matrix(b.column("embedding"))
            key = b.column("cid").to_numpy()[at].astype(np.int64) * SALTS + b.column("__salt").to_numpy()[at]
            o = np.argsort(key, kind="stable")
            own, first, n = np.unique(key[o], return_index=True, return_counts=True)
            s = np.add.reduceat(x[o], first, axis=0) if len(own) else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([pa.array((own // SALTS).astype(np.int32)), pa.array((own % SALTS).astype(np.int32)), pa.array(n), pa.array([r.tobytes() for r in s], pa.binary())], ["cid", "salt", "n", "s"])

    def add(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(r) for r in t["s"].to_pylist())
        return pa.table({"cid": t["cid"].slice(0, 1), "salt": t["salt"].slice(0, 1), "n": pa.array([int(t["n"].to_numpy().sum())]), "s": pa.array([s.tobytes()], pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        s, n = sum(np.frombuffer(r) for r in t["s"].to_pylist()), int(t["n"].to_numpy().sum())
        return pa.table({"cid": pa.array([t["cid"][0].as_py()] * len(s), pa.int32()), "pos": pa.array(np.arange(len(s), dtype=np.int32)), "mean": pa.array(s / n), "n_vectors": pa.array(np.full(len(s), n, np.int64))})

    row = "cid int, salt int, n bigint, s binary"
    parts = salted(m, "cid", heavy, ["vec_id"]).select("cid", "__salt", "embedding").mapInArrow(partial, row)
    return parts.groupBy("cid", "salt").applyInArrow(add, row).groupBy("cid").applyInArrow(mean, "cid int, pos int, mean double, n_vectors bigint")
