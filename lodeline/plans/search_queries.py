"""Queries on vectors: functions, exact search, quantisers, inverted file, graphs, evaluation. Searches take as queries the vectors whose id is divisible by
20, against all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import vectors as V
from lodeline.functions.kernels import matrix
from lodeline.operators import evaluate, exact, graph, ivf, kmeans, pq, sq8
from lodeline.plans.runtime import read

K, NLIST, NPROBE, SUBS, CODES, LONGER = 10, 16, 12, 8, 16, 30


def _e(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "embedding")


def _q(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and the one with the next id."""
    e = _e(spark, d)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _r(c, digits: int = 6):
    return F.round(c, digits)


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", _r(V.cosine_score(F.col("embedding"), F.col("b"))).alias("score"))


def raw_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", _r(V.raw_cosine(F.col("embedding"), F.col("b"))).alias("cosine"), _r(V.cosine_distance(F.col("embedding"), F.col("b"))).alias("distance"))


def euclidean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", _r(V.sq_l2(F.col("embedding"), F.col("b"))).alias("sq"), _r(V.l2(F.col("embedding"), F.col("b"))).alias("l2"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "vectors").select("vec_id", "ingested_at", "embedding").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    x = x.groupBy("vec_id").agg(F.max_by("embedding", "ingested_at").alias("embedding"))
    return x.select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("pos", "x")).groupBy("vec_id").agg(_r(F.sum(F.col("x") * (F.col("pos") + 1)), 5).alias("checksum"), _r(F.max("x"), 5).alias("largest"))


def subvectors(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return e.select("vec_id", F.expr("cast(p div 8 as int)").alias("m"), F.expr("p % 8").alias("j"), F.col("x").cast("double").alias("x")).groupBy("vec_id", "m").agg(_r(F.sum(F.col("x") * (F.col("j") + 1))).alias("checksum"))


def sq_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return exact.batch_topk(e, _q(e), K, "sq_l2").select("qid", "vec_id", "rk", _r(-F.col("score")).alias("sq"))


def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    q = [float(x) for x in e.where("vec_id = 0").first().embedding]
    return exact.topk(e, q, K).select("vec_id", _r("score").alias("score"))


def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return exact.batch_topk(e, _q(e), K).select("qid", "vec_id", "rk", _r("score").alias("score"))


def topk_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    docs = read(spark, d, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("docket_no").alias("metadata"))
    return exact.with_metadata(exact.batch_topk(e, _q(e), K), docs).select("qid", "vec_id", "rk", _r("score").alias("score"), "metadata")


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    near = exact.batch_topk(e, _q(e), K + 1).where("qid <> vec_id")
    return near.select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), _r("score").alias("score"))


def knn_graph_pruned(spark: SparkSession, d: str) -> DataFrame:
    return graph.pruned(knn_graph(spark, d), 4)


def sq8_train(spark: SparkSession, d: str) -> DataFrame:
    return sq8.train(_e(spark, d)).select("pos", _r("mn").alias("mn"), _r("mx").alias("mx"))


def sq8_encode(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return sq8.encode(e, sq8.train(e)).select("vec_id", F.posexplode("codes").alias("pos", "code")).select("vec_id", "pos", F.col("code").cast("int").alias("code"))


def _decoded(e: DataFrame) -> DataFrame:
    model = sq8.train(e)
    return sq8.decode(sq8.encode(e, model), model)


def sq8_decode(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_e(spark, d)).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", _r("x").alias("x"))


def sq8_error(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return sq8.error(e, _decoded(e)).select(_r("mean_error").alias("mean_error"), _r("max_error").alias("max_error"))


def _sq8_batch(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    model = sq8.train(e)
    return sq8.search(sq8.encode(e, model), model, _q(e), K)


def sq8_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sq8_batch(spark, d).select("qid", "vec_id", "rk", _r("score").alias("score"))


def sq8_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    model = sq8.train(e)
    return sq8.search(sq8.encode(e, model), model, _q(e).where("qid = 0"), K).select("vec_id", "rk", _r("score").alias("score"))


def _kmeans(e: DataFrame, iterations: int) -> np.ndarray:
    return kmeans.lloyd(e, kmeans.first_vectors(e, NLIST), iterations, 0.0)


def kmeans_1iter(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.centroid_rows(spark, _kmeans(_e(spark, d), 1)).withColumn("cx", _r("cx"))


def kmeans_3iter(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.centroid_rows(spark, _kmeans(_e(spark, d), 3)).withColumn("cx", _r("cx"))


def _ivf(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    e = _e(spark, d)
    return e, np.arange(NLIST), _kmeans(e, 1)


def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return ivf.assign(*_ivf(spark, d)).select("vec_id", "cid", _r("score").alias("score"))


def ivf_partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ivf.assign(*_ivf(spark, d)).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


def ivf_coarse(spark: SparkSession, d: str) -> DataFrame:
    e, cids, c = _ivf(spark, d)
    return ivf.assign(_q(e), cids, c, NPROBE, "q", "qid").select("qid", "cid", "rk", _r("score").alias("score"))


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    e, cids, c = _ivf(spark, d)
    return ivf.search(ivf.with_cell(e, cids, c), cids, c, _q(e), K, NPROBE).select("qid", "vec_id", "rk", _r("score").alias("score"))


def pq_train_step(spark: SparkSession, d: str) -> DataFrame:
    return pq.codebook_rows(spark, pq.train(_e(spark, d), SUBS, CODES, 1)).withColumn("cx", _r("cx"))


def _pq(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    e = _e(spark, d)
    return e, pq.start_codebooks(e, SUBS, CODES)


def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    return pq.encode(*_pq(spark, d)).select("vec_id", F.posexplode("codes").alias("m", "code")).select("vec_id", "m", F.col("code").cast("int").alias("code"))


def pq_distance_table(spark: SparkSession, d: str) -> DataFrame:
    e, c = _pq(spark, d)
    shared = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = matrix(b.column(1), c.shape[0] * c.shape[2])
            t = pq.distance_table(x, shared.value).round(6)
            i, m, k = (y.ravel() for y in np.indices(t.shape))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[i])), pa.array(m, pa.int32()), pa.array(k, pa.int32()), pa.array(t.ravel())], ["qid", "m", "code", "c"])

    return _q(e).mapInArrow(run, "qid bigint, m int, code int, c double")


def pq_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    e, c = _pq(spark, d)
    return pq.search_reranked(pq.encode(e, c), c, e, _q(e), K, LONGER).select("qid", "vec_id", "rk", _r("score").alias("score"))


def pq_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e, c = _pq(spark, d)
    return pq.search(pq.encode(e, c), c, _q(e), K).select("qid", "vec_id", "rk", _r("score").alias("score"))


def pq_adc_topk(spark: SparkSession, d: str) -> DataFrame:
    e, c = _pq(spark, d)
    return pq.search(pq.encode(e, c), c, _q(e).where("qid = 0"), K).select("vec_id", "rk", _r("score").alias("score"))


def pq_stats(spark: SparkSession, d: str) -> DataFrame:
    s = pq.stats(_e(spark, d).count(), pq.sub_spaces(64), 8)
    return spark.createDataFrame([tuple(s.values())], "vector_count bigint, memory_bytes bigint, full_precision_bytes bigint, compression_ratio double")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return evaluate.recall(_sq8_batch(spark, d), exact.batch_topk(e, _q(e), K)).select("qid", _r("recall").alias("recall"))


def hnsw_levels(spark: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(graph.level_of(b.column(0).to_numpy(), graph.HNSWConfig()))], ["vec_id", "level"])

    return _e(spark, d).select("vec_id").mapInArrow(run, "vec_id bigint, level int").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def hnsw_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    nodes = graph.build(e, graph.shards_for(e.count(), 500))
    return graph.search(nodes, e, _q(e), K)


def hnsw_pq_topk(spark: SparkSession, d: str) -> DataFrame:
    e, c = _pq(spark, d)
    codes = pq.encode(e, c).withColumnRenamed("codes", "embedding")

    nodes = graph.build(e, graph.shards_for(e.count(), 500))
    return graph.search(nodes, codes, _q(e), K, prepare=pq.table_scores(c))


def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether each index reaches a mean recall of 0.9 against the exact search."""
    e = _e(spark, d)
    truth = exact.batch_topk(e, _q(e), K)
    found = {"hnsw": hnsw_topk(spark, d), "ivf": ivf_topk(spark, d), "pq_rerank": pq_rerank_topk(spark, d), "sq8": _sq8_batch(spark, d)}
    out = None
    for name, f in found.items():
        r = evaluate.recall(f, truth).agg((F.avg("recall") >= 0.9).alias("reached")).select(F.lit(name).alias("index"), "reached")
        out = r if out is None else out.union(r)
    return out


def hnsw_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.sizes(read(spark, d, "hnsw_nodes"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(read(spark, d, "hnsw_nodes"))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(read(spark, d, "hnsw_nodes")).groupBy("shard", "layer", "src").agg(F.count(F.lit(1)).alias("degree")).groupBy("layer", "degree").agg(F.count(F.lit(1)).alias("n"))


E = """e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS MATERIALIZED (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 20 = 0)"""
X = """x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(len(v)))::INTEGER AS pos FROM e)"""
PAIR = f"WITH {E}, p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def _top(score: str, out: str, source: str = "q CROSS JOIN e", k: int = K, by: str = "") -> str:
    return f"""s AS (SELECT qid, vec_id, {score} AS sc FROM {source} {by}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, vec_id)::INTEGER AS rk FROM s)
SELECT {out} FROM r WHERE rk <= {k}"""


COS = "(1 + list_cosine_similarity(qv, v)) / 2"
BATCH = f"WITH {E}, {_top(COS, 'qid, vec_id, rk, round(sc, 6) AS score')}"
KNN = f"WITH {E}, {_top(COS, 'qid AS src, vec_id AS dst, round(sc, 6) AS score', k=K + 1)} AND qid <> vec_id"
SQ8 = f"""WITH {E}, {X},
model AS MATERIALIZED (SELECT pos, min(x) AS mn, max(x) AS mx FROM x GROUP BY pos),
codes AS MATERIALIZED (SELECT vec_id, pos, CASE WHEN mx - mn < 1e-10 THEN 0 ELSE floor(greatest(0, least(255, (x - mn) / (mx - mn) * 255)))::INTEGER END AS code FROM x JOIN model USING (pos)),
dec AS MATERIALIZED (SELECT vec_id, pos, mn + code / 255.0::DOUBLE * (mx - mn) AS y FROM codes JOIN model USING (pos)),
dv AS MATERIALIZED (SELECT vec_id, list(y ORDER BY pos) AS v FROM dec GROUP BY vec_id)"""
SQ8_TOP = SQ8 + ", " + _top("list_cosine_similarity(qv, v)", "qid, vec_id, rk, round(sc, 6) AS score", "q CROSS JOIN dv")


def _lloyd(n: int) -> str:
    sql = f"WITH {E}, {X}, c0 AS MATERIALIZED (SELECT vec_id::INTEGER AS cid, v AS c FROM e WHERE vec_id < {NLIST})"
    for i in range(n):
        sql += f""", a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, cid, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e CROSS JOIN c{i}) GROUP BY vec_id),
m{i} AS (SELECT cid, list(y ORDER BY pos) AS c FROM (SELECT cid, pos, avg(x) AS y FROM x JOIN a{i} USING (vec_id) GROUP BY cid, pos) GROUP BY cid),
c{i + 1} AS MATERIALIZED (SELECT cid, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cid))"""
    return sql


def _lloyd_out(n: int) -> str:
    return _lloyd(n) + f" SELECT cid, unnest(range(len(c)))::INTEGER AS pos, round(unnest(c), 6) AS cx FROM c{n}"


ASSIGN = _lloyd(1) + """, near AS MATERIALIZED (SELECT vec_id, cid, sc FROM (SELECT vec_id, cid, sc, row_number() OVER (PARTITION BY vec_id ORDER BY round(sc, 12) DESC, cid) AS n
  FROM (SELECT vec_id, cid, (1 + list_cosine_similarity(v, c)) / 2 AS sc FROM e CROSS JOIN c1)) WHERE n = 1)"""
COARSE = ASSIGN + f""", probe AS MATERIALIZED (SELECT * FROM (SELECT qid, qv, cid, sc AS csc, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 12) DESC, cid)::INTEGER AS crk
  FROM (SELECT qid, qv, cid, (1 + list_cosine_similarity(qv, c)) / 2 AS sc FROM q CROSS JOIN c1)) WHERE crk <= {NPROBE})"""
PQ = f"""WITH {E}, {X},
sub AS MATERIALIZED (SELECT vec_id, m, list(x ORDER BY pos) AS s FROM (SELECT vec_id, pos // 8 AS m, pos, x FROM x) GROUP BY vec_id, m),
book AS MATERIALIZED (SELECT m, vec_id::INTEGER AS code, list_transform(s, lambda z: z / sqrt(list_dot_product(s, s))) AS c FROM sub WHERE vec_id < {CODES}),
cosines AS MATERIALIZED (SELECT vec_id, sub.m, code, s, c, list_dot_product(s, c) / sqrt(list_dot_product(s, s)) AS cs FROM sub JOIN book USING (m)),
enc AS MATERIALIZED (SELECT vec_id, m, s, code FROM (SELECT vec_id, m, s, code, row_number() OVER (PARTITION BY vec_id, m ORDER BY round(cs, 12) DESC, code DESC) AS n FROM cosines) WHERE n = 1)"""
PQ_TOP = PQ + f""", t AS (SELECT vec_id AS qid, m, code, cs FROM cosines WHERE vec_id % 20 = 0),
{_top("sum(cs) / " + str(SUBS), "qid, vec_id, rk, round(sc, 6) AS score", "t JOIN (SELECT vec_id, m, code FROM enc) USING (m, code)", by="GROUP BY qid, vec_id")}"""
EDGES = """WITH n AS (SELECT shard, id, neighbors FROM hnsw_nodes WHERE id IS NOT NULL AND shard IS NOT NULL),
l AS (SELECT shard, id, unnest(neighbors) AS links, unnest(range(len(neighbors)))::INTEGER AS layer FROM n),
d AS (SELECT DISTINCT shard, layer, id AS src, dst FROM (SELECT shard, layer, id, unnest(links) AS dst FROM l) WHERE dst IS NOT NULL AND id <> dst),
edges AS (SELECT * FROM d SEMI JOIN (SELECT DISTINCT shard, id AS dst FROM n) USING (shard, dst))"""

QUERIES = {
    "cosine_pairs": (cosine_pairs, f"{PAIR} SELECT vec_id, round((1 + list_cosine_similarity(a, b)) / 2, 6) AS score FROM p"),
    "raw_cosine": (raw_cosine, f"{PAIR} SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(1 - list_cosine_similarity(a, b), 6) AS distance FROM p"),
    "euclidean_pairs": (euclidean_pairs, f"{PAIR} SELECT vec_id, round(list_distance(a, b) ** 2, 6) AS sq, round(list_distance(a, b), 6) AS l2 FROM p"),
    "l2_normalize": (
        l2_normalize,
        """WITH u AS (SELECT vec_id, arg_max(embedding, ingested_at)::DOUBLE[] AS v FROM vectors WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY vec_id),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM u),
x AS (SELECT vec_id, unnest(CASE WHEN n > 1e-10 THEN list_transform(v, lambda z: z / n) ELSE v END) AS x, unnest(range(len(v))) AS pos FROM n)
SELECT vec_id, round(sum(x * (pos + 1)), 5) AS checksum, round(max(x), 5) AS largest FROM x GROUP BY vec_id""",
    ),
    "subvectors": (subvectors, f"WITH {E}, {X} SELECT vec_id, (pos // 8)::INTEGER AS m, round(sum(x * (pos % 8 + 1)), 6) AS checksum FROM x GROUP BY 1, 2"),
    "sq_l2_topk": (sq_l2_topk, f"WITH {E}, {_top('-(list_distance(qv, v) ** 2)', 'qid, vec_id, rk, round(-sc, 6) AS sq')}"),
    "exact_topk": (exact_topk, f"WITH {E} SELECT vec_id, round(sc, 6) AS score FROM (SELECT vec_id, {COS} AS sc FROM q CROSS JOIN e WHERE qid = 0) ORDER BY round(sc, 9) DESC, vec_id LIMIT {K}"),
    "batch_topk": (batch_topk, BATCH),
    "topk_with_metadata": (topk_with_metadata, f"SELECT qid, vec_id, rk, score, metadata FROM ({BATCH}) LEFT JOIN (SELECT doc_id AS vec_id, max(docket_no) AS metadata FROM documents GROUP BY 1) USING (vec_id)"),
    "knn_graph": (knn_graph, KNN),
    "knn_graph_pruned": (knn_graph_pruned, f"""WITH k AS ({KNN}), b AS (SELECT src, dst, score FROM k UNION SELECT dst, src, score FROM k)
SELECT * FROM (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INTEGER AS rk FROM b) WHERE rk <= 4"""),
    "sq8_train": (sq8_train, SQ8 + " SELECT pos, round(mn, 6) AS mn, round(mx, 6) AS mx FROM model"),
    "sq8_encode": (sq8_encode, SQ8 + " SELECT vec_id, pos, code FROM codes"),
    "sq8_decode": (sq8_decode, SQ8 + " SELECT vec_id, pos, round(y, 6) AS x FROM dec"),
    "sq8_error": (sq8_error, SQ8 + " SELECT round(avg(abs(x - y)), 6) AS mean_error, round(max(abs(x - y)), 6) AS max_error FROM x JOIN dec USING (vec_id, pos)"),
    "sq8_topk": (sq8_topk, f"SELECT vec_id, rk, score FROM ({SQ8_TOP}) WHERE qid = 0"),
    "sq8_batch_topk": (sq8_batch_topk, SQ8_TOP),
    "kmeans_1iter": (kmeans_1iter, _lloyd_out(1)),
    "kmeans_3iter": (kmeans_3iter, _lloyd_out(3)),
    "ivf_assign": (ivf_assign, ASSIGN + " SELECT vec_id, cid, round(sc, 6) AS score FROM near"),
    "ivf_partition_sizes": (ivf_partition_sizes, ASSIGN + " SELECT cid, count(*) AS n FROM near GROUP BY cid"),
    "ivf_coarse": (ivf_coarse, COARSE + " SELECT qid, cid, crk AS rk, round(csc, 6) AS score FROM probe"),
    "ivf_topk": (ivf_topk, COARSE + ", " + _top(COS, "qid, vec_id, rk, round(sc, 6) AS score", "probe JOIN near USING (cid) JOIN e USING (vec_id)")),
    "pq_train_step": (
        pq_train_step,
        PQ + """, mean AS (SELECT m, code, list(y ORDER BY j) AS c FROM (SELECT m, code, j, avg(x) AS y FROM (SELECT m, code, unnest(s) AS x, unnest(range(8))::INTEGER AS j FROM enc) GROUP BY m, code, j) GROUP BY m, code),
new AS (SELECT m, code, CASE WHEN mean.c IS NULL THEN book.c ELSE list_transform(mean.c, lambda z: z / sqrt(list_dot_product(mean.c, mean.c))) END AS c FROM book LEFT JOIN mean USING (m, code))
SELECT m::INTEGER AS m, code, unnest(range(8))::INTEGER AS j, round(unnest(c), 6) AS cx FROM new""",
    ),
    "pq_encode": (pq_encode, PQ + " SELECT vec_id, m::INTEGER AS m, code FROM enc"),
    "pq_distance_table": (pq_distance_table, PQ + " SELECT vec_id AS qid, m::INTEGER AS m, code, round(cs, 6) AS c FROM cosines WHERE vec_id % 20 = 0"),
    "pq_adc_topk": (pq_adc_topk, f"SELECT vec_id, rk, score FROM ({PQ_TOP}) WHERE qid = 0"),
    "pq_batch_topk": (pq_batch_topk, PQ_TOP),
    "pq_stats": (pq_stats, "SELECT count(*) AS vector_count, count(*) * 8 AS memory_bytes, count(*) * 256 AS full_precision_bytes, count(*) * 256 / greatest(count(*) * 8, 1)::DOUBLE AS compression_ratio FROM embeddings"),
    "recall_at_k": (recall_at_k, f"""WITH f AS ({SQ8_TOP}), t AS ({BATCH})
SELECT t.qid, round(count(f.vec_id) / count(*)::DOUBLE, 6) AS recall FROM t LEFT JOIN f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid"""),
    "pq_rerank_topk": (pq_rerank_topk, PQ + f""", t AS (SELECT vec_id AS qid, m, code, cs FROM cosines WHERE vec_id % 20 = 0),
a AS (SELECT qid, vec_id, sum(cs) / {SUBS} AS sc FROM t JOIN (SELECT vec_id, m, code FROM enc) USING (m, code) GROUP BY qid, vec_id),
w AS (SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, vec_id) AS n FROM a) WHERE n <= {K * LONGER}),
{_top(COS, "qid, vec_id, rk, round(sc, 6) AS score", "w JOIN q USING (qid) JOIN e USING (vec_id)")}"""),
    "index_recall": (index_recall, "SELECT unnest(['hnsw', 'ivf', 'pq_rerank', 'sq8']) AS index, true AS reached"),
    "hnsw_sizes": (hnsw_sizes, "SELECT shard, count(DISTINCT id) AS n, max(level) + 1 AS n_layers FROM hnsw_nodes WHERE id IS NOT NULL AND shard IS NOT NULL GROUP BY shard"),
    "hnsw_levels": (hnsw_levels, """SELECT least(16, floor(-ln((('0x' || substr(md5(vec_id || ':0'), 1, 13))::UBIGINT + 0.5::DOUBLE) * pow(2.0, -52)) / ln(16)))::INTEGER AS level, count(*) AS n
FROM embeddings GROUP BY 1"""),
    "hnsw_topk": (hnsw_topk, None),
    "hnsw_pq_topk": (hnsw_pq_topk, None),
    "graph_edges": (graph_edges, EDGES + " SELECT shard, layer, src, dst FROM edges"),
    "graph_degrees": (graph_degrees, EDGES + " SELECT layer, degree, count(*) AS n FROM (SELECT shard, layer, src, count(*) AS degree FROM edges GROUP BY ALL) GROUP BY ALL"),
}
