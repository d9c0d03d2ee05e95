"""Clusters of mutually similar vectors (problem 5): k-means over hashed weighted features, seeded by parallel oversampling.

A vector's features are its elements, over its norm, weighted by how little each spreads over the corpus, and added with a sign into the
hashed dimensions; the features have norm 1. Seeding: in each of a few passes every vector gets the key -log(u) / (squared distance to
the seeds so far), u a hash of its id, and those of the smallest keys become seeds: a weighted draw of many seeds by one pass. The seeds,
weighted by the vectors nearest to them, are reduced to k on the driver. Each pass of Lloyd's algorithm sums in the
tasks and adds up k sums.

Tight clusters (every two members of at least a given score) are the exact sets of ``mutual``, with the centroids as its points.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.kmeans import lloyd, seed_far, sq_dist
from lodeline.llm import mutual
from lodeline.llm.mutual import pack
from lodeline.llm.neighbours import as_matrix, unit
from lodeline.plans.runtime import materialize

#: Hashed dimensions.
FEATURES = 128
SEED_PASSES = 4
#: How near to a border (in the units of the features) a vector visits the other side. Of a cut set, the member nearest to the border is mostly nearer.
MARGIN = 0.05
_SUB = 2000


def hash_features(dim: int, weights: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """dim x features: where each element goes, with sign and weight."""
    p = np.zeros((dim, features))
    for j in range(dim):
        h = int.from_bytes(hashlib.blake2b(j.to_bytes(4, "little"), digest_size=8).digest(), "little")
        p[j, (h >> 1) % features] = (1 if h & 1 else -1) * weights[j]
    return p


def _features(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    y = unit(v) @ p
    n = np.sqrt((y * y).sum(1, keepdims=True))
    return (y / np.where(n > 0, n, 1)).astype(np.float32)


def _u(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each id, always the same."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h.astype(np.float64) + 1) / (2.0**64 + 2)


def nlist_of(config: DataFrame, default: int = 100) -> int:
    """nlist of the latest row that has one above 0 (by created_at, then config_id)."""
    r = config.where("nlist > 0").orderBy(F.desc_nulls_last("created_at"), F.desc("config_id")).select("nlist").limit(1).collect()
    return r[0][0] if r else default


class Model(mutual.Cells):
    def __init__(self, p: np.ndarray, centroids: np.ndarray, cut: np.ndarray | None = None, margin: float = MARGIN):
        """cut: the centroids that divide what was one cell."""
        super().__init__(centroids)
        self.p, self.margin = p, margin
        self.cut = np.zeros(len(centroids), bool) if cut is None else cut

    def features(self, v: np.ndarray) -> np.ndarray:
        return _features(v, self.p)

    def slack(self) -> np.ndarray:
        wider = 1 + 3 * (self.cut[:, None] | self.cut)  # a cut cell's borders run through its sets
        return (2 * self.margin * wider * np.sqrt(sq_dist(self.points, self.points))).astype(np.float32)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, _SUB):
            c = b.slice(s, _SUB)
            yield c, as_matrix(c.column("v"), dim)


def _sum_rows(packed: DataFrame, dim: int, groups: int, width: int, what) -> np.ndarray:
    """groups x width: sums over all vectors. what(ids, v) -> (group of each row, rows). Each task gives one row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((groups, width))
        for b, v in _slices(batches, dim):
            g, x = what(v)
            o = np.argsort(g, kind="stable")
            at, first = np.unique(g[o], return_index=True)
            s[at] += np.add.reduceat(x[o], first, axis=0)
        at = np.flatnonzero(s.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([r.tobytes() for r in s[at]], pa.binary())], ["g", "s"])

    def add(t: pa.Table) -> pa.Table:
        s = np.zeros(width)
        for r in t["s"].to_pylist():
            s += np.frombuffer(r)
        return pa.table({"g": t["g"].slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

    out = np.zeros((groups, width))
    for r in packed.select("v").mapInArrow(run, "g int, s binary").groupBy("g").applyInArrow(add, "g int, s binary").toArrow().to_pylist():
        out[r["g"]] = np.frombuffer(r["s"])
    return out


def fit(packed: DataFrame, n: int, k: int, dim: int, iterations: int = 8, tolerance: float = 1e-3, features: int = FEATURES, seed: int = 5) -> Model:
    """k-means over all vectors. The driver holds the seeds (about 8 k) and the centroids."""
    spark = packed.sparkSession
    moments = _sum_rows(packed, dim, 1, 2 * dim, lambda v: (np.zeros(len(v), np.int64), np.hstack([x := unit(v), x * x])))[0] / n
    spread = np.sqrt(np.maximum(moments[dim:] - moments[:dim] ** 2, 1e-12))
    weights = np.clip(np.median(spread) / spread, 0.5, 2)
    p = hash_features(dim, weights, features)
    seeds = np.zeros((0, features), np.float32)
    many = 2 * k
    for turn in range(SEED_PASSES + 1):
        now = spark.sparkContext.broadcast(seeds)

        def draw(batches: Iterator[pa.RecordBatch], turn: int = turn, now=now) -> Iterator[pa.RecordBatch]:
            best = np.zeros(0), np.zeros((0, features), np.float32)
            for b, v in _slices(batches, dim):
                y = _features(v, p)
                d = sq_dist(y, now.value).min(1) if len(now.value) else np.ones(len(y))
                key = np.where(d > 1e-9, -np.log(_u(b.column("vec_id").to_numpy(), seed + turn)) / np.maximum(d, 1e-9), np.inf)
                key, y = np.concatenate([best[0], key]), np.vstack([best[1], y])
                o = np.argsort(key, kind="stable")[:many]
                best = key[o[np.isfinite(key[o])]], y[o[np.isfinite(key[o])]]
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array([r.tobytes() for r in best[1]], pa.binary())], ["key", "y"])

        drawn = materialize(packed.select("vec_id", "v").mapInArrow(draw, "key double, y binary").orderBy("key").limit(1 if turn == 0 else many), "seeds")
        got = drawn.select("y").toArrow()["y"].to_pylist()
        seeds = np.vstack([seeds, np.frombuffer(b"".join(got), np.float32).reshape(-1, features)])
        if not got:
            break
    seeds = seeds.astype(np.float64)
    weight = _sum_rows(packed, dim, len(seeds), 1, lambda v: (sq_dist(_features(v, p), seeds.astype(np.float32)).argmin(1), np.ones((len(v), 1))))[:, 0]
    c = _reduce(seeds, weight, k, seed)
    for _ in range(iterations):
        model = Model(p, c)

        def near(v: np.ndarray, model: Model = model) -> tuple[np.ndarray, np.ndarray]:
            y = model.features(v)
            return sq_dist(y, model.points.astype(np.float32)).argmin(1), np.hstack([y.astype(np.float64), np.ones((len(y), 1))])

        s = _sum_rows(packed, dim, len(c), features + 1, near)
        new = np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), c)
        moved = float(((new - c) ** 2).sum())
        c = new
        if moved < tolerance:
            break
    return Model(p, c)


def _reduce(seeds: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of weighted points, by Lloyd's algorithm on the driver."""
    if len(seeds) <= k:
        return seeds
    rng = np.random.default_rng(seed)
    c = seed_far(seeds, k, rng, block=1)
    for _ in range(10):
        near = sq_dist(seeds, c).argmin(1)
        s, w = np.zeros_like(c), np.zeros(k)
        np.add.at(s, near, seeds * weight[:, None])
        np.add.at(w, near, weight)
        c = np.where(w[:, None] > 0, s / np.maximum(w, 1e-12)[:, None], c)
    return c


def describe(packed: DataFrame, model: Model, dim: int, typical: int = 5) -> DataFrame:
    """``cluster, size, rk, vec_id, distance``: the size of each k-means cluster and its ``typical`` members nearest to the centroid, by
    rk (ties by id)."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _slices(batches, dim):
            d = shared.value.distances(v)
            c = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), b.column("vec_id"), pa.array(np.round(np.sqrt(d[np.arange(len(c)), c].astype(np.float64)), 6))], ["cluster", "vec_id", "distance"])

    a = materialize(packed.select("vec_id", "v").mapInArrow(run, "cluster int, vec_id bigint, distance double"), "clusters")
    w = Window.partitionBy("cluster").orderBy("distance", "vec_id")
    top = a.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= typical)
    return top.join(a.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster").select("cluster", "size", "rk", "vec_id", "distance")


def _cut_hot(packed: DataFrame, model: Model, dim: int, hot: int) -> tuple[Model, dict[int, int]]:
    """The model for routing, and the sizes of its cells above ``hot``: their centroids give way to several, fitted on a bounded sample of their rows, up to
    three times. Cells that this can't divide (of rows that are all alike) stay hot, and are met in blocks."""
    for turn in range(4):
        size = mutual.hot_cells(packed, model, dim, hot)
        if not size or turn == 3:
            break
        c, cut, big = model.points, model.cut, np.array(sorted(size))
        part = min(1.0, 4096 * len(big) / sum(size.values()))
        sample = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("v")

        def only(batches: Iterator[pa.RecordBatch], m: Model = model, big: np.ndarray = big) -> Iterator[pa.RecordBatch]:
            for b, v in _slices(batches, dim):
                a = m.distances(v).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(a[i := np.isin(a, big)], pa.int32()), b.column("v").take(pa.array(np.flatnonzero(i)))], ["c", "v"])

        t = sample.mapInArrow(only, "c int, v binary").limit(8192 * len(big)).toArrow()
        at, y = t["c"].to_numpy(), model.features(as_matrix(t["v"].combine_chunks(), dim)).astype(np.float64) if t.num_rows else np.zeros((0, c.shape[1]))
        rest = np.setdiff1d(np.arange(len(c)), big)
        new, kept = [c[rest]], [cut[rest]]
        for b in big:
            own = y[at == b]
            own = np.unique(own, axis=0) if len(own) else own
            parts = min(len(own), 2 * math.ceil(size[b] / hot))
            new.append(lloyd(own, parts, seed=1) if parts > 1 else c[[b]])
            kept.append(np.full(len(new[-1]), parts > 1 or cut[b]))
        if sum(map(len, new)) == len(c):
            break
        model = Model(model.p, np.vstack(new), np.concatenate(kept), model.margin)
    return model, size


def tight_clusters(vectors: DataFrame, k: int = 100, min_score: float = 0.90, least: int = 5, dim: int = 128, margin: float = MARGIN, hot: int = mutual.HOT) -> DataFrame:
    """``cluster_id, vec_id``: the sets of at least ``least`` vectors of which every two score at least ``min_score``, and which no further vector can
    join; cluster_id is the smallest vec_id of the set.

    vectors: ``vec_id, embedding`` as given by ``usable``. k is raised to sqrt(n) / 5 for large n. Exact within cells, and across
    borders for vectors within ``margin`` (see ``mutual``). No vectors give no rows; copies are members like others."""
    spark = vectors.sparkSession
    packed = pack(vectors, dim)
    n = packed.count()
    if n < least:
        return spark.createDataFrame([], "cluster_id bigint, vec_id bigint")
    k = min(max(k, math.isqrt(n) // 5), n)
    model = fit(packed, n, k, dim)
    model, size = _cut_hot(packed, Model(model.p, model.points, margin=margin), dim, hot)
    return mutual.mutual_sets(packed, model, min_score, least, dim, size, hot).withColumnRenamed("set_id", "cluster_id")
