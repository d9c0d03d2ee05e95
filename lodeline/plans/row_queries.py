"""Queries on ids, metadata and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import evaluate, exact, metadata
from lodeline.plans.runtime import read
from lodeline.plans.search_queries import BATCH, COS, E, K, _e, _q, _r, _top
from lodeline.plans.strategy import decide_mode_column


def _meta(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of each vector id: of repeated rows the latest, of several at that time the greatest text."""
    v = read(spark, d, "vectors").where("vec_id is not null")
    return v.groupBy("vec_id").agg(F.max(F.struct("ingested_at", "metadata")).getField("metadata").alias("metadata"))


META = "m AS MATERIALIZED (SELECT vec_id, metadata FROM (SELECT vec_id, metadata, row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at DESC NULLS LAST, metadata DESC NULLS LAST) AS n FROM vectors WHERE vec_id IS NOT NULL) WHERE n = 1)"


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    """The ids that the delete queries remove: those that orders of large prices name."""
    return read(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("vec_id")).distinct()


GONE = "gone AS MATERIALIZED (SELECT DISTINCT o_custkey AS vec_id FROM orders WHERE o_totalprice > 480000)"


def metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).withColumn("ext_id", F.concat(F.lit("x-"), F.col("vec_id").cast("string")))
    m = m.withColumn("enriched", metadata.enrich("metadata", "ext_id"))
    return m.select("vec_id", F.get_json_object("enriched", "$.__id__").alias("id"), F.get_json_object("enriched", "$.topic").alias("topic"))


def get_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    ids = m.select("vec_id", F.concat(F.lit("x-"), F.col("vec_id").cast("string")).alias("ext_id"))
    return metadata.get(ids, m, "x-42").select("ext_id", "vec_id", "metadata")


def metadata_get_batch(spark: SparkSession, d: str) -> DataFrame:
    request = read(spark, d, "search_results").groupBy("qid").agg(F.max("vec_id").alias("vec_id")).select(F.col("qid").alias("ord"), "vec_id")
    return metadata.get_batch(request, _meta(spark, d))


def metadata_delete(spark: SparkSession, d: str) -> DataFrame:
    return metadata.delete(_meta(spark, d), _deleted(spark, d), "vec_id").select("vec_id", "metadata")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return metadata.duplicates(read(spark, d, "vectors"), "vec_id")


def dim_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return metadata.wrong_dimension(read(spark, d, "vectors"), 128)


def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    return metadata.delete(_e(spark, d), _deleted(spark, d), "vec_id").select("vec_id")


def all_ids(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("ext_id"))


def count_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimension"))


def count_after_delete(spark: SparkSession, d: str) -> DataFrame:
    return delete_ids(spark, d).agg(F.count(F.lit(1)).alias("n"))


def search_after_delete_pre(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return exact.batch_topk(metadata.delete(e, _deleted(spark, d), "vec_id"), _q(e), K).select("qid", "vec_id", "rk", _r("score").alias("score"))


def search_after_delete_post(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return metadata.delete(exact.batch_topk(e, _q(e), K), _deleted(spark, d), "vec_id").select("qid", "vec_id", "rk", _r("score").alias("score"))


def external_ids(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    ids = e.select("vec_id", F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("ext_id"))
    return exact.with_external_ids(exact.batch_topk(e, _q(e), K), ids).select("qid", "rk", "ext_id", _r("score").alias("score"))


def auto_mode_decision(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 97 % 200000).alias("n"), (F.col("p_size") / 3.0).alias("ram_gb"))
    return p.select("p_partkey", decide_mode_column(F.col("n"), F.col("ram_gb")).alias("mode"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentiles(read(spark, d, "events"), "value").select(_r("p50").alias("p50"), _r("p99").alias("p99"))


def percentile_index(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentile_index(read(spark, d, "events"), "value", 99).select(_r("value").alias("value"))


KEEP = "ANTI JOIN gone USING (vec_id)"
QUERIES = {
    "metadata_enrich": (
        metadata_enrich,
        f"""WITH {META}, j AS (SELECT vec_id, metadata, coalesce(json_valid(metadata), false) AS ok FROM m)
SELECT vec_id, CASE WHEN NOT ok OR json_type(metadata) = 'OBJECT' THEN 'x-' || vec_id END AS id, CASE WHEN ok AND json_type(metadata) = 'OBJECT' THEN json_extract_string(metadata, '$.topic') END AS topic FROM j""",
    ),
    "get_metadata": (get_metadata, f"WITH {META} SELECT 'x-' || vec_id AS ext_id, vec_id, metadata FROM m WHERE vec_id = 42"),
    "metadata_get_batch": (metadata_get_batch, f"WITH {META} SELECT ord, vec_id, metadata FROM (SELECT qid AS ord, max(vec_id) AS vec_id FROM search_results GROUP BY qid) LEFT JOIN m USING (vec_id)"),
    "metadata_delete": (metadata_delete, f"WITH {META}, {GONE} SELECT vec_id, metadata FROM m {KEEP}"),
    "duplicate_ids": (duplicate_ids, "SELECT vec_id, count(*) AS n FROM vectors WHERE vec_id IS NOT NULL GROUP BY vec_id HAVING count(*) > 1"),
    "dim_mismatch": (dim_mismatch, "SELECT vec_id, coalesce(len(embedding), -1)::INTEGER AS actual, 128 AS expected FROM vectors WHERE coalesce(len(embedding), -1) <> 128"),
    "delete_ids": (delete_ids, f"WITH {GONE} SELECT vec_id FROM embeddings {KEEP}"),
    "all_ids": (all_ids, "SELECT 'doc_' || vec_id AS ext_id FROM embeddings"),
    "count_vectors": (count_vectors, "SELECT count(*) AS n, max(len(embedding))::INTEGER AS dimension FROM embeddings"),
    "count_after_delete": (count_after_delete, f"WITH {GONE} SELECT count(*) AS n FROM embeddings {KEEP}"),
    "search_after_delete_pre": (search_after_delete_pre, f"WITH {GONE}, {E}, {_top(COS, 'qid, vec_id, rk, round(sc, 6) AS score', 'q CROSS JOIN (SELECT * FROM e ' + KEEP + ')')}"),
    "search_after_delete_post": (search_after_delete_post, f"WITH {GONE}, b AS ({BATCH}) SELECT qid, vec_id, rk, score FROM b {KEEP}"),
    "external_ids": (external_ids, f"SELECT qid, rk, 'doc_' || vec_id AS ext_id, score FROM ({BATCH})"),
    "auto_mode_decision": (auto_mode_decision, "SELECT p_partkey, CASE WHEN p_partkey * 97 % 200000 < 50000 THEN 'flat' WHEN p_size / 3.0 < 8 THEN 'sq8' ELSE 'hnsw' END AS mode FROM part"),
    "latency_percentiles": (latency_percentiles, "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events"),
    "percentile_index": (percentile_index, "SELECT round(value, 6) AS value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) WHERE i = least(n - 1, n * 99 // 100) "),
}
