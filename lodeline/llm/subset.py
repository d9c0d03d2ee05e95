"""A varied subset, and crowds of near-equal vectors (problem 1), by a grid over several attributes, in SQL.

Attributes: a vector over its norm is cut into the sub-spaces of the product quantiser's codebooks; in each, its coordinate along a
codeword direction is an attribute. The grid has bins of ``WIDTH`` in as many attributes as give about as many held cells as records are wanted. Records are
ranked within their cells, ordered by rank, then by cell, and the first k are kept, so each place of the space gives its first record before any
gives its second.

Crowds: a varied subset, a few thousand records at most, stands for all. Every record goes to the record of the subset that it is most similar to; pairs that
a border parts are found however wide a crowd spreads over it and however many borders meet there, and the crowds, which are what the subset thins out, are resolved there exactly (see ``mutual``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm import mutual
from lodeline.llm.neighbours import unit
from lodeline.plans.runtime import materialize, small_methods

WIDTH = 0.15
#: Records of the subset that stands for all, at most; it goes to all tasks.
MOST_POINTS = 8192
#: Records for each of them, in the mean. Vectors meet those of fewer cells beyond the borders where cells are small.
CELL = 512
_COUNTED = 12


def directions(codebooks: DataFrame, dim: int = 128) -> np.ndarray:
    """(sub-spaces, d): a direction in each sub-space, of its first codeword that isn't zero. Repeated rows count
    once; rows with a null don't count; where no codeword is complete (or the table is empty: 16 sub-spaces), an axis is the direction."""
    rows = codebooks.where("m is not null and code is not null and j is not null and cx is not null").groupBy("m", "code", "j").agg(F.max("cx").alias("cx")).orderBy("m", "code", "j").toPandas()
    subs = int(rows["m"].max()) + 1 if len(rows) else 16
    d = dim // subs
    out = np.zeros((subs, d))
    for m in range(subs):
        own = rows[rows["m"] == m]
        words = [np.array(w["cx"]) for _, w in own.groupby("code") if len(w) == d and np.abs(w["cx"]).sum() > 0 and np.isfinite(w["cx"]).all()]
        w = [*words, np.eye(d)[0]][0]
        out[m] = w / np.linalg.norm(w)
    return out


def binned(vectors: DataFrame, dirs: np.ndarray, width: float = WIDTH) -> DataFrame:
    """``vec_id, embedding, bins``: the bin of each attribute. vectors as given by ``usable``."""
    subs, d = dirs.shape
    # Written out term by term, which is compiled; higher-order functions over nested arrays are not.
    x = vectors.select("vec_id", "embedding", F.col("embedding").cast("array<double>").alias("x"))
    x = x.withColumn("norm", F.expr("sqrt(" + " + ".join(f"x[{j}] * x[{j}]" for j in range(subs * d)) + ")"))
    f = [f"cast(floor(({' + '.join(f'x[{m * d + j}] * {float(dirs[m, j])!r}D' for j in range(d))}) / norm / {width}D) as tinyint)" for m in range(subs)]
    return x.select("vec_id", "embedding", F.expr(f"array({', '.join(f)})").alias("bins"))


def varied_subset(vectors: DataFrame, codebooks: DataFrame, k: int, dim: int = 128, width: float = WIDTH) -> DataFrame:
    """``vec_id, cell, rk``: k of the vectors (all, if fewer) that cover their variety: ranked within their cells by a hash of the id
    and ordered by rank, then cell. k < 1 or no vectors give no rows; copies share a cell and so come late. See ``first_of_cells``."""
    dirs = directions(codebooks, dim)
    with small_methods(vectors.sparkSession):
        rows = materialize(binned(vectors, dirs, width).drop("embedding"), "bins")
    return first_of_cells(rows, len(dirs), k)


def first_of_cells(rows: DataFrame, subs: int, k: int) -> DataFrame:
    """``vec_id, cell, rk`` of the k records that come first by rank, then cell. rows: ``vec_id, bins``, a table.

    The grid takes the most attributes with which it has at most k held cells (counted by a sketch of 2 % error), one at least. The counts of the cells (as a histogram) say
    at which rank and cell the k-th record comes; only so many rows of a cell leave a task, however many it holds, and nothing is sorted as a whole."""
    spark = rows.sparkSession
    if k < 1:
        return rows.select("vec_id", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("rk")).limit(0)
    held = rows.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(F.slice("bins", 1, m + 1)), F.lit(12))) for m in range(subs)]).first()
    used = max([1, *(m + 1 for m in range(subs) if held[m] <= k)])
    rows.createOrReplaceTempView("__lodeline_bins")
    c = spark.sql(f"SELECT vec_id, xxhash64(slice(bins, 1, {used})) AS cell FROM __lodeline_bins")
    counts = materialize(c.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy(F.least("n", F.lit(k)).alias("n")).agg(F.count(F.lit(1)).alias("cells")).toPandas()
    n, w = sizes["n"].to_numpy(), sizes["cells"].to_numpy()
    lo, hi = 1, int(n.max()) if len(n) else 1
    while lo < hi:  # the least rank with which k records are reached
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if int((np.minimum(n, mid) * w).sum()) >= k else (mid + 1, hi)
    left = k - int((np.minimum(n, lo - 1) * w).sum())
    last = _nth(counts.where(F.col("n") >= lo).select("cell"), left)
    c.createOrReplaceTempView("__lodeline_cells")
    return spark.sql(
        f"""SELECT vec_id, cell, rk FROM (SELECT vec_id, cell, row_number() OVER (PARTITION BY cell ORDER BY xxhash64(vec_id), vec_id) AS rk FROM __lodeline_cells)
        WHERE rk <= {lo} AND (rk < {lo} OR cell <= {last})"""
    )


def _nth(cells: DataFrame, n: int) -> int:
    """The n-th smallest of distinct numbers (the largest there is, if they are fewer), by counting those in ever smaller equal parts of the range."""
    low, bits = -(1 << 63), 64
    while bits > 0:
        bits = max(0, bits - _COUNTED)
        part = cells.where(F.col("cell").between(low, min((1 << 63) - 1, low + (1 << min(64, bits + _COUNTED)) - 1))).groupBy(F.shiftright("cell", bits).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for r in part:
            if r.n >= n:
                break
            n -= r.n
        else:
            return (1 << 63) - 1
        low = r.p << bits
    return low


def crowds(vectors: DataFrame, codebooks: DataFrame, min_score: float = 0.985, least: int = 20, dim: int = 128, cell: int = CELL, hot: int = mutual.HOT) -> DataFrame:
    """``crowd_id, vec_id``: the sets of at least ``least`` vectors of which every two score at least ``min_score``, and which no further vector can
    join; crowd_id is the smallest vec_id of the set.

    vectors as given by ``usable``. No vectors give no rows; copies are members like others. Sets that
    overlap are all given (see ``cliques``), those of one smallest id as one. Driver: MOST_POINTS vectors at most."""
    dirs = directions(codebooks, dim)
    with small_methods(vectors.sparkSession):
        packed = mutual.pack(binned(vectors, dirs), dim, "bins array<tinyint>")
    n = packed.count()
    if n < least:
        return vectors.sparkSession.createDataFrame([], "crowd_id bigint, vec_id bigint")
    k = min(MOST_POINTS, math.ceil(n / cell))
    subset = first_of_cells(packed.select("vec_id", "bins"), len(dirs), k)
    points = packed.join(F.broadcast(subset.select("vec_id")), "vec_id").select("v").toArrow()["v"].to_pylist()  # k rows
    places = mutual.Cells(unit(np.frombuffer(b"".join(sorted(set(points))), np.float32).reshape(-1, dim)), whole=True)
    sizes = mutual.hot_cells(packed, places, dim, 0)
    places.slices = mutual.slices_of(places.points, sizes, mutual.SLICE_BYTES // (2 * dim))
    return mutual.mutual_sets(packed, places, min_score, least, dim, {c: m for c, m in sizes.items() if m > hot}, hot).withColumnRenamed("set_id", "crowd_id")
