import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.functions import kernels
from lodeline.functions import vectors as V


def one(spark, a, b, f):
    d = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return d.select(f(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    "a, b, want",
    [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0, 0.0], [0.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.5), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], None), ([], [], 1.0)],
)
def test_cosine_score(spark, a, b, want):
    assert one(spark, a, b, V.cosine_score) == want


def test_kernel_agrees_with_column(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 8))
    x[3] = 0
    q = x[[1, 3]]
    d = spark.createDataFrame([(i, j, x[i].tolist(), q[j].tolist()) for i in range(20) for j in range(2)], "i int, j int, a array<double>, b array<double>")
    got = {(r.i, r.j): r.s for r in d.select("i", "j", V.cosine_score(F.col("a"), F.col("b")).alias("s")).collect()}
    want = kernels.cosine(q, x)
    assert all(abs(got[i, j] - want[j, i]) < 1e-12 for i in range(20) for j in range(2))


def test_normalize_and_distances(spark):
    assert one(spark, [3.0, 4.0], [0.0, 0.0], lambda a, b: V.l2_normalize(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], [0.0, 0.0], lambda a, b: V.l2_normalize(a)) == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], [0.0, 0.0], V.sq_l2) == 25.0
    assert one(spark, [3.0, 4.0], [0.0, 0.0], V.l2) == 5.0
    assert one(spark, [3.0, 4.0], [0.0, 0.0], V.raw_cosine) == 0.0
    assert one(spark, [3.0, 4.0], [0.0, 0.0], V.cosine_distance) == 1.0
    assert one(spark, [1.0, 2.0, 3.0, 4.0], [0.0], lambda a, b: V.subvector(a, 1, 2)) == [3.0, 4.0]


def test_topk_keeps_ties_by_id():
    t = kernels.TopK(1, 2)
    t.add(np.array([[0.5, 0.9, 0.5]]), np.array([7, 5, 3]))
    t.add(np.array([[0.9, np.nan]]), np.array([4, 1]))
    assert t.rows()[1].tolist() == [4, 5]
