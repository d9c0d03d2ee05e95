import numpy as np
import pytest

from lodeline.functions.kernels import TopK
from lodeline.operators import evaluate, exact, graph, ivf, kmeans, pq, sq8
from lodeline.sources.synthetic import adversarial

SCHEMA = "vec_id bigint, embedding array<float>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def queries(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid bigint, q array<double>")


@pytest.fixture(scope="module")
def data(spark):
    d = adversarial(spark, 400, 32).persist()
    rows = d.orderBy("vec_id").collect()
    return d, np.array([r.embedding for r in rows])


def brute(x, q, k):
    s = (1 + (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T) / 2
    return [set(np.lexsort((np.arange(len(x)), -r.round(9)))[:k].tolist()) for r in s]


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, set()).add(r.vec_id)
    return out


def test_exact_matches_brute_force_in_slices(spark, data, monkeypatch):
    d, x = data
    want = brute(x, x[:12], 5)
    monkeypatch.setattr(exact, "query_slices", lambda q: iter([(np.arange(6), x[:6]), (np.arange(6, 12), x[6:12])]))
    got = lists(exact.batch_topk(d, None, 5))
    assert all(got[i] == want[i] for i in range(12))


def test_exact_single_and_k(spark, data):
    d, x = data
    top = exact.topk(d, x[3].tolist(), 5).collect()
    assert top[0].vec_id == 3 and top[0].score == pytest.approx(1, abs=1e-5)
    assert exact.topk(d, x[3].tolist(), 0).count() == 0 and exact.topk(d, x[3].tolist(), 1000).count() == 400


def test_nulls_ragged_and_empty(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (None, [1.0, 0.0]), (5, [1.0, None])], SCHEMA)
    got = exact.batch_topk(d, queries(spark, np.array([[1.0, 0.0]])), 3)
    assert [(r.vec_id, r.rk) for r in got.collect()] == [(1, 1)]
    assert exact.batch_topk(d.limit(0), queries(spark, np.array([[1.0, 0.0]])), 3).count() == 0
    assert exact.batch_topk(d, queries(spark, np.zeros((0, 2))), 3).count() == 0


def test_equal_scores_by_id(spark):
    d = frame(spark, np.array([[1.0, 0.0]] * 6), [9, 8, 7, 6, 5, 4])
    assert [r.vec_id for r in exact.batch_topk(d, queries(spark, np.array([[2.0, 0.0]])), 3).orderBy("rk").collect()] == [4, 5, 6]


def test_sq8_fixture(spark):
    t = frame(spark, np.array([[0, 0.5, 1], [0.1, 0.6, 0.9], [0.2, 0.4, 1]]))
    model = sq8.train(t, 3)
    p = frame(spark, np.array([[0.15, 0.55, 0.95]]))
    back = sq8.decode(sq8.encode(p, model), model).first().embedding
    assert max(abs(a - b) for a, b in zip(back, [0.15, 0.55, 0.95])) < 0.1
    with pytest.raises(ValueError):
        sq8.train(t.limit(0), 3)
    with pytest.raises(ValueError):
        sq8.train(t, 4)


def test_sq8_search_finds_itself(spark, data):
    d, x = data
    model = sq8.train(d, 32)
    got = sq8.search(sq8.encode(d, model), model, queries(spark, x[:10]), 1).collect()
    assert all(r.qid == r.vec_id and r.score > 0.9 for r in got)


def test_pq(spark, data):
    d, x = data
    assert pq.sub_spaces(128) == 16 and pq.sub_spaces(1536) == 192
    with pytest.raises(ValueError):
        pq.sub_spaces(130)
    c = pq.train(d, 4, 64, 10)
    assert c.shape == (4, 64, 8) and np.allclose(np.linalg.norm(c, axis=2), 1, atol=1e-6)
    assert pq.stats(100, 192, 8)["compression_ratio"] == 32
    codes = pq.encode(d, c)
    assert all(len(r.codes) == 4 and max(r.codes) < 64 for r in codes.collect())
    got = lists(pq.search(codes, c, queries(spark, x[:20]), 10))
    assert np.mean([i in got[i] for i in range(20)]) > 0.9


def test_kmeans_and_ivf(spark, data, tmp_path):
    d, x = data
    c = kmeans.lloyd(d, kmeans.first_vectors(d, 8), 5)
    assert c.shape == (8, 32)
    cids = np.arange(8)
    cells = ivf.with_cell(d, cids, c)
    q = queries(spark, x[:20])
    whole = lists(ivf.search(cells, cids, c, q, 5, 8))
    assert all(whole[i] == w for i, w in enumerate(brute(x, x[:20], 5)))
    part = ivf.search(cells, cids, c, q, 5, 2)
    assert part.groupBy("qid").count().count() == 20
    cells.write.partitionBy("cid").parquet(str(tmp_path / "cells"))
    one = ivf.search(spark.read.parquet(str(tmp_path / "cells")), cids, c, queries(spark, x[:1]), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cid" in plan and plan.count("Exchange hashpartitioning") == 1  # only the tasks' lists are shuffled


def test_hnsw_fixture(spark):
    x = np.array([[i, 1.0] for i in range(5)])
    nodes = graph.build(frame(spark, x), 1)
    got = graph.search(nodes, frame(spark, x), queries(spark, x[:1]), 3).orderBy("rk").collect()
    assert [r.vec_id for r in got] == [0, 1, 2] and got[0].score == pytest.approx(1)


def test_hnsw_recall(spark, data):
    d, x = data
    truth = exact.batch_topk(d, queries(spark, x[:40]), 10)
    nodes = graph.build(d, 3)
    found = graph.search(nodes, d, queries(spark, x[:40]), 10)
    assert evaluate.recall(found, truth).agg({"recall": "avg"}).first()[0] >= 0.9
    levels = graph.level_of(np.arange(1000), graph.HNSWConfig())
    n = np.bincount(levels)
    assert n[0] > 400 and n[0] > n[1] > n[2] and len(n) <= graph.TOP_LEVEL + 1


def test_graph_edges_clean(spark):
    n = spark.createDataFrame([(1, 1, [[1, 2, 2, None, 9], None]), (1, 2, None), (None, 3, [[1]]), (1, 2, [[1]])], "shard int, id bigint, neighbors array<array<bigint>>")
    assert sorted(map(tuple, graph.edges(n).collect())) == [(1, 0, 1, 2), (1, 0, 2, 1)]


def test_scores_are_rounded_once(spark):
    """At 9 decimals the score would be 0.2243535, which is 0.224354 at 6."""
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    found = exact.batch_topk(rows, rows.toDF("qid", "q"), 1, scores=lambda q, x: np.full((len(q), len(x)), 0.2243534999996))
    assert [r.score for r in found.selectExpr("round(score, 6) AS score").collect()] == [0.224353]


def test_graph_walks_of_many_queries(spark):
    """All queries walk at once, each as it would alone, and the links of a graph are the true nearest of those that came before."""
    rng = np.random.default_rng(3)
    x = graph._unit(rng.standard_normal((400, 16)))
    begin, to = graph.layer_links(x, 4, 8)
    far = (1 - x @ x.T) / 2
    chosen = [set(sorted(range(i), key=lambda j: (far[i, j], j))[:4]) for i in range(len(x))]
    both = [sorted(chosen[i] | {j for j in range(len(x)) if i in chosen[j]}, key=lambda j: (far[i, j], j))[:8] for i in range(len(x))]
    assert [to[begin[i] : begin[i + 1]].tolist() for i in range(len(x))] == both
    q = graph._unit(rng.standard_normal((50, 16)))
    g = graph.Graph([[links] for links in both], 0)
    d = ((1 - q @ x.T) / 2).astype(np.float32)
    assert (g.search(d.copy(), 400)[:, :50] == np.argsort(d, 1, kind="stable")[:, :50]).mean() > 0.99  # a beam as wide as the graph
    met = g.search(d.copy(), 20)
    assert all((g.search(d[i : i + 1].copy(), 20) == met[i]).all() for i in range(50)) and all(len(set(r)) == 20 for r in met.tolist())
    deep = [[[1], [2]], [[0, 2]], [[1], [0]]]  # rows 0 and 2 have a second layer
    assert graph.Graph(deep, 0).search(np.array([[0.5, 0.25, 0.0]], np.float32), 4).tolist() == [[2, 1, 0, 3]]


def test_best_of_many_small_batches():
    """What is below the k-th best so far is left out before it is sorted; the lists are the same."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 40, (30, 900)) / 39
    s[rng.random(s.shape) < 0.05] = np.nan
    best = TopK(30, 4)
    for b in range(0, 900, 90):
        best.add(s[:, b : b + 90].copy(), np.arange(b, b + 90))
    order = np.lexsort((np.broadcast_to(np.arange(900), s.shape), -np.where(np.isnan(s), -1, s)), axis=-1)[:, :4]
    assert best.rows()[1].reshape(30, 4).tolist() == order.tolist()
    rising = TopK(2000, 4)
    sorted_rows = []
    was, np.lexsort = np.lexsort, lambda keys, axis=-1: sorted_rows.append(keys[0].shape) or was(keys, axis=axis)
    try:
        for b in range(20):
            rising.add(np.full((2000, 100), 1.0 - b / 100), np.arange(100))
    finally:
        np.lexsort = was
    assert sum(n * m for n, m in sorted_rows[1:]) == 0
