"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import clusters, encode, mixing, neighbours, subset, topn, truncation
from lodeline.operators.usable import usable
from lodeline.plans.runtime import read


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(read(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.plan_mixtures(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.drawn_records(_mixture(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report.where("short").select("mix_id", "source").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return subset.crowds(usable(read(spark, d, "vectors")), read(spark, d, "pq_codebooks"))


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    return subset.varied_subset(usable(read(spark, d, "vectors")), read(spark, d, "pq_codebooks"), 1000)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.knn(usable(read(spark, d, "vectors")), k=5, min_score=0.90))


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn_lists(usable(read(spark, d, "vectors")), k=5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(topn.valid_items(read(spark, d, "search_results")), 10).select("qid", "vec_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.tight_clusters(usable(read(spark, d, "vectors")), clusters.nlist_of(read(spark, d, "ivf_config")))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    packed = clusters.pack(usable(read(spark, d, "vectors")), 128)
    model = clusters.fit(packed, packed.count(), clusters.nlist_of(read(spark, d, "ivf_config")), 128)
    return clusters.describe(packed, model, 128)


P4_SQL = """
WITH latest AS (
  SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid, vec_id ORDER BY received_at DESC NULLS LAST, CASE WHEN score IS NULL THEN 0 WHEN isnan(score) THEN 2 ELSE 1 END DESC, score DESC) AS n
  FROM search_results WHERE qid IS NOT NULL AND vec_id IS NOT NULL),
ranked AS (
  SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS n FROM latest WHERE n = 1 AND score IS NOT NULL AND NOT isnan(score))
SELECT qid, vec_id FROM ranked WHERE n <= 10
"""


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(read(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_subset": p1_subset,
    "p2_found": p2_found,
    "p2_knn": p2_knn,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_report": p7_report,
    "p7_records": p7_records,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}
