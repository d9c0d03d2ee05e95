"""Navigable small-world graphs, one per shard, and neighbour graphs by set operations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.kernels import matrix
from lodeline.operators.exact import SCHEMA, query_slices, ranked

#: Shards at most that are walked together, one after another, so that their lists are merged in their task.
TOGETHER = 8
#: Highest level of a node.
TOP_LEVEL = 16


@dataclass(frozen=True)
class HNSWConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 0

    @property
    def m_max0(self) -> int:
        return 2 * self.m

    @property
    def ml(self) -> float:
        return 1 / math.log(self.m)


def level_of(ids: np.ndarray, config: HNSWConfig) -> np.ndarray:
    """floor(-ln u x ml), at most TOP_LEVEL; u in (0, 1) comes from the MD5 of the id and the seed (its first 52 bits), so builds repeat."""
    bits = np.array([int(hashlib.md5(b"%d:%d" % (i, config.seed)).hexdigest()[:13], 16) for i in ids.tolist()], np.float64)
    return np.minimum(np.floor(-np.log((bits + 0.5) * 2.0**-52) * config.ml), TOP_LEVEL).astype(np.int32)


def layer_links(x: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's links begin, rows linked to, nearest first) of a layer in which the rows were inserted in their order: a row links to the ``first`` nearest of those before it, they
    link back, and of a row's links the ``most`` nearest stay. Which do doesn't depend on when the others go, so all rows are linked at once, from blocks of products in place of
    a beam for each row; the nearest are the true ones, not those that a beam meets."""
    src, dst, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for s in range(0, len(x), step := max(1, (1 << 21) // max(1, len(x)))):
        d = (1 - x[s : s + step] @ x[: s + step].T) / 2
        i = np.arange(len(d))
        d[i[:, None] + s <= np.arange(d.shape[1])] = np.inf
        near = np.argpartition(d, first - 1, axis=1)[:, :first] if d.shape[1] > first else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        own = np.take_along_axis(d, near, 1)
        r, c = np.nonzero(own < np.inf)
        src.append(r + s), dst.append(near[r, c]), far.append(own[r, c])
    u, v, w = map(np.concatenate, (src, dst, far))
    u, v, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
    o = np.lexsort((v, w, u))
    u, v = u[o], v[o]
    stay = np.arange(len(u)) - np.searchsorted(u, u, "left") < most
    return np.searchsorted(u[stay], np.arange(len(x) + 1)), v[stay]


class Graph:
    """A stored graph over rows 0..n-1, walked by many queries at once. links: for each row, for each of its layers, rows."""

    def __init__(self, links: list[list[list[int]]], entry: int):
        self.n, self.entry, self.layers = len(links), entry, []
        for layer in range(len(links[entry]) if links else 0):
            at = [i for i, own in enumerate(links) if len(own) > layer]
            # Rows without the layer have the last place, which stands for no links; so does a place without a link, which is at row n.
            place = np.full(self.n + 1, len(at))
            place[at] = np.arange(len(at))
            to = np.full((len(at) + 1, max([1, *(len(links[i][layer]) for i in at)])), self.n)
            for p, i in enumerate(at):
                to[p, : len(links[i][layer])] = links[i][layer]
            self.layers.append((place, to))

    def search(self, far: np.ndarray, ef: int) -> np.ndarray:
        """(queries, ef): the nearest rows that a beam of ``ef`` meets, nearest first; n where there are fewer. far: distances (single precision, not below 0) of the queries to
        all rows, which is overwritten. Each step takes every query's nearest row that wasn't taken yet and meets its links; a query ends when its beam has none."""
        queries = np.arange(len(far))
        far = np.hstack([far, np.full((len(far), 1), np.inf, np.float32)])
        near = np.full(len(far), self.entry)
        for place, to in self.layers[:0:-1]:
            moving = queries
            while len(moving):
                links = to[place[near[moving]]]
                d = far[moving[:, None], links]
                best = d.argmin(1)
                better = d[np.arange(len(moving)), best] < far[moving, near[moving]]
                near[moving[better]] = links[better, best[better]]
                moving = moving[better]
        # A beam is sorted numbers: the distance's bits, the row, and whether it was taken.
        key = lambda d, rows: d.view(np.int32).astype(np.int64) << 32 | rows << 1
        place, to = self.layers[0]
        nothing = key(np.full(1, np.inf, np.float32), np.array([self.n]))[0] | 1
        beam = np.full((len(far), ef), nothing)
        beam[:, 0] = key(far[queries, near], near)
        far[queries, near] = np.inf
        moving = queries
        while True:
            free = (beam[moving] & 1) == 0
            moving = moving[free.any(1)]
            if not len(moving):
                return (beam & 0xFFFFFFFF) >> 1
            taken = free[free.any(1)].argmax(1)
            row = (beam[moving, taken] & 0xFFFFFFFF) >> 1
            beam[moving, taken] |= 1
            links = to[place[row]]
            d = far[moving[:, None], links]
            far[moving[:, None], links] = np.inf
            new = key(d, links)
            new[np.isinf(d)] = nothing
            beam[moving] = np.sort(np.hstack([beam[moving], new]), axis=1)[:, :ef]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def shards_for(n: int, rows: int = 5000) -> int:
    return max(1, math.ceil(n / rows))


def build(vectors: DataFrame, shards: int, config: HNSWConfig = HNSWConfig()) -> DataFrame:
    """``shard, id, level, neighbors`` (array per layer, of ids). One graph per shard = hash of the id, built in the task that holds the shard; ``shards_for`` keeps shards of a bounded size. Null and ragged vectors are left out; repeated ids are inserted once each."""
    d = vectors.where("vec_id is not null and embedding is not null").select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")

    def one(t: pa.Table) -> pa.Table:
        x, at = matrix(t["embedding"])
        ids = t["vec_id"].to_numpy()[at]
        o = np.argsort(ids, kind="stable")
        x, ids = _unit(x[o]), ids[o]
        level = level_of(ids, config)
        links: list[list[list[int]]] = [[] for _ in ids]
        for layer in range(int(level.max(initial=-1)) + 1):
            there = np.flatnonzero(level >= layer)
            most = config.m if layer else config.m_max0
            begin, to = layer_links(x[there], min(most, config.ef_construction), most)
            to = ids[there[to]]
            for n, i in enumerate(there.tolist()):
                links[i].append(to[begin[n] : begin[n + 1]].tolist())
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(ids), pa.int32()), "id": ids, "level": level, "neighbors": pa.array(links, pa.list_(pa.list_(pa.int64())))})

    return d.groupBy("shard").applyInArrow(one, "shard int, id bigint, level int, neighbors array<array<bigint>>")


def search(nodes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, config: HNSWConfig = HNSWConfig(), prepare: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """``qid, vec_id, rk, score`` as ``batch_topk``, approximately: each shard's graph gives the best of a beam, which are merged by query, those of up to TOGETHER shards in their task.
    nodes: as given by ``build``; vectors: ``vec_id, embedding`` (or codes, with ``prepare``, which makes of a query, once, a function
    of stored rows that gives their scores, higher better)."""
    spark = nodes.sparkSession
    d = nodes.join(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "id")
    shards = nodes.agg(F.max("shard")).first()[0] or 0
    together = max(1, min(TOGETHER, shards // (4 * spark.sparkContext.defaultParallelism)))
    d = d.select(F.floor(F.col("shard") / together).alias("some"), "shard", "id", "level", "neighbors", "v")
    out = None
    for qids, q in query_slices(queries) if k > 0 else ():
        shared = spark.sparkContext.broadcast((qids, q))

        part = d.groupBy("some").applyInArrow(_beams(shared, k, config, prepare), SCHEMA)
        out = part if out is None else out.union(part)
    return ranked(out if out is not None else spark.createDataFrame([], SCHEMA), k)


def _beams(shared, k: int, config: HNSWConfig, prepare) -> Callable[[pa.Table], pa.Table]:
    def one(t: pa.Table) -> pa.Table:
        qids, q = shared.value
        score, of = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        z = q if prepare else _unit(q)
        shards = t["shard"].to_numpy(zero_copy_only=False)
        for shard in np.unique(shards):
            own = t.filter(pa.array(shards == shard))
            x, at = matrix(own["v"])
            if not len(at):
                continue
            ids, level = own["id"].to_numpy()[at], own["level"].to_numpy()[at]
            place = {i: n for n, i in enumerate(ids.tolist())}
            links = own["neighbors"].to_pylist()
            links = [[[place[j] for j in layer or [] if j in place] for layer in links[a] or []] or [[]] for a in at]
            g = Graph(links, int(np.lexsort((ids, -level))[0]))
            y = x if prepare else _unit(x)
            small = y.astype(np.float32)
            for s in range(0, len(q), step := max(1, (1 << 22) // len(y))):
                some = z[s : s + step]
                near = np.stack([prepare(one)(y) for one in some]).astype(np.float32) if prepare else (1 + some.astype(np.float32) @ small.T) / 2
                met = g.search(np.maximum(1 - near, 0), max(config.ef_search, k))[:, :k]
                found, rows = met < len(y), np.minimum(met, len(y) - 1)
                exact = np.stack([prepare(one)(y[r]) for one, r in zip(some, rows)]) if prepare else (1 + np.einsum("ij,ikj->ik", some, y[rows])) / 2
                both = np.hstack([score[s : s + step], np.where(found, exact, -np.inf).round(9)])
                who = np.hstack([of[s : s + step], ids[rows]])
                o = np.lexsort((who, -both), axis=-1)[:, :k]
                score[s : s + step], of[s : s + step] = np.take_along_axis(both, o, 1), np.take_along_axis(who, o, 1)
        n, j = np.nonzero(score > -np.inf)
        return pa.table({"qid": pa.array(qids[n], pa.int64()), "vec_id": of[n, j], "s": score[n, j]})

    return one


def sizes(nodes: DataFrame) -> DataFrame:
    """``shard, n, n_layers``: the distinct nodes of each shard, and its layers. Null shards and ids don't count; a shard without any has no row."""
    n = nodes.where("id is not null and shard is not null")
    return n.groupBy("shard").agg(F.countDistinct("id").alias("n"), (F.max("level") + 1).alias("n_layers"))


def edges(nodes: DataFrame) -> DataFrame:
    """``shard, layer, src, dst``: distinct links of stored nodes, without null lists, self links and links to ids that the shard doesn't hold."""
    n = nodes.where("id is not null and shard is not null").select("shard", "id", F.posexplode("neighbors").alias("layer", "links"))
    e = n.select("shard", "layer", F.col("id").alias("src"), F.explode("links").alias("dst")).where("dst is not null and src <> dst").distinct()
    return e.join(nodes.select("shard", F.col("id").alias("dst")).distinct(), ["shard", "dst"], "left_semi").select("shard", "layer", "src", "dst")


def pruned(links: DataFrame, most: int) -> DataFrame:
    """``src, dst, score, rk``: links and their reverses, the ``most`` best of each src. links: ``src, dst, score``."""
    both = links.select("src", "dst", "score").union(links.select("dst", "src", "score")).distinct()
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return both.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)
