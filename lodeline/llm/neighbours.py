"""The k most similar vectors of every vector (problem 2), by an inverted multi-index.

Unit vectors are quantised half by half; a cell is a pair of half centroids. Cells that lie together form groups of about ``GROUP`` entries or fewer. A vector
goes to the group of the nearest mean and to each other whose mean is hardly farther: by how much follows from the sample, so that a vector visits
``VISITS`` groups in the mean, whatever the number of vectors. All vectors that meet in a group are entries and queries there, home or not, so a pair is found
where any two of their groups are the same. In the group the same is done again with leaves around centroids of its own rows; vectors that meet in a leaf are scored in single precision, and
those that may be among the best are reranked by the exact score.

A cell with more entries than ``HOT`` is cut into blocks of entries and of queries, with a group for each pair of blocks, so that no group
holds more than a block of either, and nothing is cut. Vectors of equal content are one row of the products, and travel as one row for each batch, whatever their number.

The visits are made for neighbours of score 0.9 or more. ``knn_lists`` gives the k nearest of all vectors: those whose k-th one lies beyond that
reach are scored against every vector, from the score that the index found for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.kmeans import lloyd, nearest, sq_dist
from lodeline.plans.runtime import materialize, parallelism

#: Vectors at most, chosen by a hash of their ids, on which the half centroids are fitted (all are indexed).
SAMPLE = 32768
#: Half centroids at most; there are about as many as the square root of the number of vectors.
MOST_CENTROIDS = 1024
#: Groups that a vector visits in the mean.
VISITS = 3.3
#: Vectors of the sample from which the width of the border follows.
ASKED = 4096
#: Squared distance of unit vectors of score 0.9.
REACH = 0.4
GROUP = 24576
HOT = 32768
#: Contents of a leaf, about, and the leaves that one visits in the mean.
LEAF = 256
LEAVES = 4
#: Rows of a group on which its leaves are fitted, at most.
FITTED = 8192
#: Near entries of a query in a leaf, up to which all are reranked one by one.
FEW = 64
#: Elements of a block of scores.
BLOCK = 1 << 20
#: Bytes of vectors that are scored against all others in one pass.
SLICE_BYTES = 16 << 20


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of norm 1, in double. The scale is taken out first, so that no square under- or overflows."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list or binary column of ``dim`` floats each, without nulls."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class MultiIndex:
    """The half centroids, and where the entries of each cell are."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 0):
        self.dim = sample.shape[1]
        self.half = self.dim // 2
        self.k = max(4, min(MOST_CENTROIDS, 1 << math.ceil(math.log2(max(1, n)) / 2)))
        x = unit(sample)
        self.c1 = lloyd(x[:, : self.half], self.k, seed=seed)
        self.c2 = lloyd(x[:, self.half :], self.k, seed=seed + 1)

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(v)
        return sq_dist(x[:, : self.half], self.c1), sq_dist(x[:, self.half :], self.c2)

    def cells(self, v: np.ndarray) -> np.ndarray:
        x = unit(v)
        return nearest(x[:, : self.half], self.c1)[0] * self.k + nearest(x[:, self.half :], self.c2)[0]

    def place(self, cells: np.ndarray, counts: np.ndarray, group: int = GROUP, hot: int = HOT) -> None:
        """Places, which are sets of cells, with a group each (a hot cell is a place with a group for each pair of blocks): place[cell], or -1; first[place], its first group;
        spread[place], its number of blocks; mean[place]. The cells of a first centroid stay together, with those of centroids like it; only a first centroid of more entries
        than a group is divided by its second ones."""
        self.of = np.full(self.k * self.k, -1, np.int32)
        first, spread, mean = [], [], []

        def new(at: np.ndarray, blocks: int = 1) -> None:
            self.of[cells[at]] = len(first)
            first.append(first[-1] + spread[-1] ** 2 if first else 0)
            spread.append(blocks)
            mean.append(np.average(self.centres(cells[at]), axis=0, weights=counts[at]))

        mass = np.bincount(cells // self.k, weights=counts, minlength=self.k)
        for part in _halved(np.flatnonzero(mass), mass[mass > 0], lambda i: self.c1[i], group):
            mine = np.flatnonzero(np.isin(cells // self.k, part))
            if counts[mine].sum() <= group:
                new(mine)
                continue
            for one in mine[counts[mine] > hot]:
                new(np.array([one]), int(math.ceil(counts[one] / hot)))
            small = mine[counts[mine] <= hot]
            if len(small):
                for sub in _halved(small, counts[small], lambda m: self.c2[cells[m] % self.k], group):
                    new(sub)
        self.first, self.spread, self.mean = np.array(first), np.array(spread), np.array(mean)

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return np.hstack([self.c1[cells // self.k], self.c2[cells % self.k]])

    def widen(self, sample: np.ndarray, visits: float) -> None:
        """Set how much farther than the nearest mean another may be, so that the vectors of the sample visit so many places in the mean."""
        self.border = border(sq_dist(unit(sample), self.mean), visits)

    def visited(self, v: np.ndarray) -> np.ndarray:
        """(vectors, places): the places that each visits; those of a hot cell, that place too."""
        d = sq_dist(unit(v), self.mean)
        may = d - d.min(1, keepdims=True) <= self.border
        own = self.of[self.cells(v)]
        hot = np.flatnonzero(self.spread[own] > 1)
        may[hot, own[hot]] = True
        return may


def border(d: np.ndarray, visits: float) -> float:
    """How much farther than the nearest place others may be, so that so many are within it in the mean. d: squared distances, vectors by places."""
    gap = (d - d.min(1, keepdims=True)).ravel()
    most = min(len(gap), math.ceil(visits * len(d)))
    return float(np.partition(gap, most - 1)[most - 1])


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows that meet: each visits the leaf of the nearest centroid, and those of others that are hardly farther."""
    n = len(x)
    if n <= 2 * LEAF * LEAVES:
        return [np.arange(n)]
    order = np.random.default_rng(0).permutation(n)
    fitted = min(FITTED, n // 2)
    centroids = lloyd(x[order[:fitted]], math.ceil(n / LEAF), 4).astype(np.float32)
    most = border(sq_dist(x[order[fitted:][:ASKED]], centroids), LEAVES)
    rows, leaf = [], []
    for s in range(0, n, 4096):
        d = sq_dist(x[s : s + 4096], centroids)
        i, j = np.nonzero(d - d.min(1, keepdims=True) <= most)
        rows.append(i + s)
        leaf.append(j)
    rows, leaf = np.concatenate(rows), np.concatenate(leaf)
    o = np.argsort(leaf, kind="stable")
    return np.split(rows[o], np.searchsorted(leaf[o], np.arange(1, len(centroids))))


def _halved(items: np.ndarray, weight: np.ndarray, point, most: float) -> list[np.ndarray]:
    """Sets of items of at most ``most`` weight (or one item), by halving across the main direction of their points, at the widest gap near
    the middle of the weight."""
    out, todo = [], [(items, weight)]
    while todo:
        m, w = todo.pop()
        if w.sum() <= most or len(m) == 1:
            out.append(m)
            continue
        x = point(m)
        x = x - (x * w[:, None]).sum(0) / w.sum()
        u = x[np.argmax((x * x).sum(1))].copy()
        for _ in range(8):
            u = x.T @ (w * (x @ u))
            u /= np.linalg.norm(u) or 1.0
        p = x @ u
        order = np.argsort(p, kind="stable")
        upto = np.cumsum(w[order]) / w.sum()
        near = (upto[:-1] >= 0.3) & (upto[:-1] <= 0.7)
        cut = int(np.argmax(np.where(near, np.diff(p[order]), -1))) + 1 if near.any() else min(len(m) - 1, int(np.searchsorted(upto, 0.5)) + 1)
        todo += [(m[order[:cut]], w[order[:cut]]), (m[order[cut:]], w[order[cut:]])]
    return out


def distinct(ids: np.ndarray, raw: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The contents of a batch, and the ids of each."""
    code, names = pd.factorize(np.array(raw, dtype=object))
    o = np.argsort(code, kind="stable")
    return list(names), np.split(ids[o], np.searchsorted(code[o], np.arange(1, len(names))))


def _routed(ids: list[np.ndarray], raw: list[bytes], visited: np.ndarray, index: MultiIndex) -> pa.RecordBatch:
    """``role``: 1 for an entry of the group, 2 for a query, 3 for both."""
    row, place = np.nonzero(visited)
    grp, role = index.first[place], np.full(len(row), 3)
    if (wide := index.spread[place] > 1).any():  # an entry meets all blocks of queries, a query all blocks of entries
        rest = [(row[~wide], grp[~wide], role[~wide])]
        for i, p in zip(row[wide].tolist(), place[wide].tolist()):
            n = int(index.spread[p])
            own = hash_id(int(ids[i][0])) % n
            at = [(own * n + j, 3 if j == own else 1) for j in range(n)] + [(j * n + own, 2) for j in range(n) if j != own]
            rest.append((np.full(len(at), i), index.first[p] + np.array([g for g, _ in at]), np.array([r for _, r in at])))
        row, grp, role = (np.concatenate(c) for c in zip(*rest))
    return pa.RecordBatch.from_arrays(
        [pa.array(grp, pa.int32()), pa.array(role, pa.int32()), pa.array([ids[i].tobytes() for i in row], pa.binary()), pa.array([raw[i] for i in row], pa.binary())], ["grp", "role", "ids", "v"]
    )


def hash_id(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40


def score_group(packed_ids: list[bytes], role: np.ndarray, raw: list[bytes], dim: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, score x 1e9 rounded): for each id of a query its k best entries among those that it meets in a leaf."""
    row_content, names = pd.factorize(np.array(raw, dtype=object))
    n = len(names)
    v = np.frombuffer(b"".join(names), np.float32).reshape(-1, dim)
    ids = np.frombuffer(b"".join(packed_ids), np.int64)
    of_row = np.repeat(np.arange(len(raw)), [len(b) // 8 for b in packed_ids])
    order = np.argsort(ids, kind="stable")
    ids, of_row = ids[order], of_row[order]
    content, role = row_content[of_row], role[of_row]
    # Entries: contents, by their smallest id; at most k + 1 ids of a content can matter to anyone.
    e_ids: list[list[int]] = [[] for _ in range(n)]
    for c, i in zip(content[role & 1 > 0].tolist(), ids[role & 1 > 0].tolist()):
        if len(e_ids[c]) <= k:
            e_ids[c].append(i)
    entries = np.array([c for c in range(n) if e_ids[c]], np.int64)
    entries = entries[np.argsort([e_ids[c][0] for c in entries], kind="stable")]
    asks = np.zeros(n, bool)
    asks[content[role & 2 > 0]] = True
    ids, content = ids[role & 2 > 0], content[role & 2 > 0]
    none = np.zeros(0, np.int64)
    if not len(entries) or not len(ids):
        return none, none, none
    place = np.full(n, n, np.int64)  # of an entry, in the order of the smallest ids
    place[entries] = np.arange(len(entries))
    m = k + 1
    near = np.concatenate([unit(v[s : s + 4096]).astype(np.float32) for s in range(0, n, 4096)])
    floor = np.float32(least / 5e8 - 1 - 1e-5)
    pairs, about, best = [none], [none.astype(np.float32)], [none]  # contents that may be near, with their scores in single precision, and the best of queries with many; a pair as one number
    for rows in leaves(near):
        e, qs = np.sort(place[rows]), rows[asks[rows]]
        e = entries[e[e < n]]
        ne = len(e)
        if not ne:
            continue
        step = max(1, BLOCK // ne)
        back = np.arange(ne - 1, -1, -1, dtype=np.int64)
        for s in range(0, len(qs), step):
            q = qs[s : s + step]
            cos = near[q] @ near[e].T
            hit = cos >= floor
            many = hit.sum(1) > FEW
            i, j = np.nonzero(hit & ~many[:, None])
            pairs.append(q[i] * n + e[j])
            about.append(cos[i, j])
            if many.any():
                q = q[many]
                key = np.rint((unit(v[q]) @ unit(v[e]).T + 1) * 5e8).astype(np.int64)
                top = np.argpartition((key << 24) | back, ne - m, axis=1)[:, ne - m :] if ne > m else np.tile(np.arange(ne), (len(q), 1))
                best.append((q[:, None] * n + e[top]).ravel())
    found, at = np.unique(np.concatenate(pairs), return_index=True)
    cos, q = np.concatenate(about)[at], found // n
    o = np.lexsort((-cos, q))
    found, cos, q = found[o], cos[o], q[o]
    begin = np.searchsorted(q, q, "left")
    last = np.minimum(begin + m, np.searchsorted(q, q, "right")) - 1  # the m-th best of the query
    fq, fe = np.divmod(np.unique(np.concatenate([found[cos >= cos[last] - np.float32(4e-6)], *best])), n)
    fs = np.concatenate([none, *(np.rint((np.einsum("ij,ij->i", unit(v[fq[s : s + 65536]]), unit(v[fe[s : s + 65536]])) + 1) * 5e8).astype(np.int64) for s in range(0, len(fq), 65536))])
    fq, fe, fs = fq[fs >= least], fe[fs >= least], fs[fs >= least]
    # Ids in place of contents, then the best k + 1 of each query content.
    each = np.array([len(i) for i in e_ids])
    flat = np.array([i for e in e_ids for i in e], np.int64)
    off = np.cumsum(each) - each
    reps = each[fe]
    pos = np.repeat(off[fe] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    fq, fs, fid = np.repeat(fq, reps), np.repeat(fs, reps), flat[pos]
    o = np.lexsort((fid, -fs, fq))
    fq, fs, fid = fq[o], fs[o], fid[o]
    rank = np.arange(len(fq)) - np.searchsorted(fq, fq, "left")
    keep = rank < m
    fq, fs, fid = fq[keep], fs[keep], fid[keep]
    # Each row of a content: without itself, k at most.
    a, b = np.searchsorted(fq, content, "left"), np.searchsorted(fq, content, "right")
    size = b - a
    pos = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    who = np.repeat(np.arange(len(ids)), size)
    other = fid[pos] != ids[who]
    pos, who = pos[other], who[other]
    keep = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
    return ids[who[keep]], fid[pos[keep]], fs[pos[keep]]


def knn(vectors: DataFrame, k: int = 5, min_score: float = 0.0, dim: int = 128, visits: float = VISITS, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """``vec_id, neighbour, rk, score``: of each vector the k other vectors of highest score (at least ``min_score``) that the index finds,
    scores rounded to 9 decimals, of equal ones the smaller id first.

    vectors: ``vec_id, embedding`` as given by ``usable`` (ids unique, vectors finite and not zero). Other columns don't matter. No
    vectors, or one, give no rows; copies are each other's neighbours. The search is approximate: pairs that score 0.9 or more are found nearly always, far ones (of
    vectors that resemble nothing) often not; ``knn_lists`` has all. Driver: it holds the sample and a count for each cell, at most MOST_CENTROIDS squared."""
    return _walked(_packed(vectors, dim), k, min_score, dim, visits, group, hot)


def _packed(vectors: DataFrame, dim: int) -> DataFrame:
    """``vec_id, v``: the elements as bytes of floats."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.ascontiguousarray(as_matrix(b.column(1), dim), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "v"])

    return materialize(vectors.select("vec_id", "embedding").mapInArrow(pack, "vec_id bigint, v binary"), "vectors")


def _walked(packed: DataFrame, k: int, min_score: float, dim: int, visits: float, group: int, hot: int) -> DataFrame:
    spark = packed.sparkSession
    out = "vec_id bigint, neighbour bigint, rk int, score double"
    n = packed.count()
    if n < 2:
        return spark.createDataFrame([], out)
    part = min(1.0, SAMPLE / n)
    sample = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("v").limit(SAMPLE).toArrow()
    sample = as_matrix(sample["v"].combine_chunks(), dim)
    index = MultiIndex(sample, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, int] = {}
        for b in batches:
            m = np.frombuffer(b"".join(dict.fromkeys(b.column(0).to_pylist())), np.float32).reshape(-1, dim)
            for c, m in zip(*(x.tolist() for x in np.unique(model.value.cells(m), return_counts=True))):
                got[c] = got.get(c, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.int64())], ["cell", "n"])

    model = spark.sparkContext.broadcast(index)
    sizes = packed.select("v").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    group = min(group, max(1024, math.ceil(n / parallelism(spark))))  # as many groups as tasks, at least
    index.place(sizes["cell"].to_numpy().astype(np.int64), sizes["n"].to_numpy(), group, hot)
    index.widen(sample[np.random.default_rng(0).permutation(len(sample))[:ASKED]], visits)
    placed = spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, ids = distinct(b.column(0).to_numpy(), b.column(1).to_pylist())
            for s in range(0, len(raw), 1000):
                part = raw[s : s + 1000]
                m = np.frombuffer(b"".join(part), np.float32).reshape(-1, dim)
                yield _routed(ids[s : s + 1000], part, placed.value.visited(m), placed.value)

    least = math.ceil(round(min_score * 1e9, 3))

    def score(t: pa.Table) -> pa.Table:
        q, e, s = score_group(t["ids"].to_pylist(), t["role"].to_numpy(), t["v"].to_pylist(), dim, k, least)
        return pa.table({"vec_id": q, "neighbour": e, "s": s})

    routed = packed.mapInArrow(route, "grp int, role int, ids binary, v binary")
    local = routed.groupBy("grp").applyInArrow(score, "vec_id bigint, neighbour bigint, s bigint")
    # A pair can meet in more groups than one.
    local = local.repartition("vec_id").groupBy("vec_id", "neighbour").agg(F.max("s").alias("s"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "neighbour")
    best = local.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return best.select("vec_id", "neighbour", "rk", (F.col("s") / 1e9).alias("score"))


def knn_lists(vectors: DataFrame, k: int = 5, dim: int = 128, visits: float = VISITS, reach: float = REACH, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``vec_id, neighbour, rk, score`` as ``knn``, of each vector the k nearest others whatever their scores: by the index where it finds k within ``reach``;
    the other vectors are scored against all, which is exact, and takes time in proportion to their number times that of all vectors."""
    packed = _packed(vectors, dim)
    first = materialize(_walked(packed, k, 0.0, dim, visits, GROUP, HOT), "walked")
    last = first.where(F.col("rk") == k).select("vec_id", F.col("score").alias("last"))
    sure = last.where(F.col("last") >= 1 - reach / 4).select("vec_id")
    loose = materialize(packed.join(sure, "vec_id", "left_anti").join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("last", F.lit(-1.0)).alias("last")), "loose")
    out = first.join(sure, "vec_id").select("vec_id", "neighbour", "rk", "score")
    parts = math.ceil(loose.count() * dim * 4 / slice_bytes)
    for p in range(parts):
        t = loose.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).toArrow()
        if t.num_rows:
            out = out.union(materialize(_against_all(packed, t["vec_id"].to_numpy(), b"".join(t["v"].to_pylist()), t["last"].to_numpy(), k, dim), "lists"))
    return out


def _against_all(packed: DataFrame, ids: np.ndarray, raw: bytes, last: np.ndarray, k: int, dim: int) -> DataFrame:
    """The k best of all vectors for each query. last: a score that the k-th best reaches at least."""
    shared = packed.sparkSession.sparkContext.broadcast((ids, raw, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, last = shared.value
        q = unit(np.frombuffer(raw, np.float32).reshape(-1, dim)).astype(np.float32)
        best = [Best(ids[s : s + 512], np.frombuffer(raw, np.float32).reshape(-1, dim)[s : s + 512], last[s : s + 512], k) for s in range(0, len(ids), 512)]
        for b in batches:
            own = b.column(0).to_numpy()
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, dim)
            for s in range(0, len(x), 2048):
                part = unit(x[s : s + 2048])
                small = np.ascontiguousarray(part.astype(np.float32).T)
                for i, one in enumerate(best):
                    one.add(q[i * 512 : (i + 1) * 512] @ small, part, own[s : s + 2048])
        for one in best:
            yield pa.RecordBatch.from_arrays([pa.array(one.ids[one.q]), pa.array(one.e), pa.array(one.s)], ["vec_id", "neighbour", "s"])

    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "neighbour")
    local = packed.mapInArrow(run, "vec_id bigint, neighbour bigint, s bigint")
    return local.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("vec_id", "neighbour", "rk", (F.col("s") / 1e9).alias("score"))


class Best:
    """The k best entries of each query, by score x 1e9 rounded, then smaller id. Products in single precision choose what is scored in double."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, last: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, unit(v), k
        self.least = 2 * last - 1 - 4e-6
        self.q, self.e, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, cos: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        least = self.least.astype(np.float32)
        if (least < -1).any() and cos.shape[1] > self.k + 1:  # itself may be among them
            least = np.maximum(least, np.partition(cos, -self.k - 1, axis=1)[:, -self.k - 1] - np.float32(4e-6))
        at = np.flatnonzero(cos >= least[:, None])
        if not len(at):
            return
        q, e = np.divmod(at, cos.shape[1])
        other = self.ids[q] != own[e]
        q, e = q[other], e[other]
        s = np.concatenate([np.zeros(0, np.int64), *(np.rint((np.einsum("ij,ij->i", self.x[q[i : i + 65536]], x[e[i : i + 65536]]) + 1) * 5e8).astype(np.int64) for i in range(0, len(q), 65536))])
        q, e, s = np.concatenate([self.q, q]), np.concatenate([self.e, own[e]]), np.concatenate([self.s, s])
        o = np.lexsort((e, -s, q))
        q, e, s = q[o], e[o], s[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < self.k
        self.q, self.e, self.s = q[keep], e[keep], s[keep]
        full = self.q[rank[keep] == self.k - 1]
        self.least[full] = np.maximum(self.least[full], self.s[rank[keep] == self.k - 1] / 5e8 - 1 - 4e-6)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``vec_a, vec_b``, vec_a < vec_b: each pair of which one is a neighbour of the other."""
    return neighbours.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
