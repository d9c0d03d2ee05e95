"""Queries on the partition log (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import skew
from lodeline.operators.usable import usable
from lodeline.plans.runtime import read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.partition_sizes(read(spark, d, "ivf_assignment")).where("share >= 0.04").select("cid")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    return skew.partition_sizes(read(spark, d, "ivf_assignment")).select("cid", "n_rows", F.round("share", 9).alias("share"))


def p3_means(spark: SparkSession, d: str) -> DataFrame:
    m = skew.partition_means(read(spark, d, "ivf_assignment"), usable(read(spark, d, "vectors")))
    return m.select("cid", "pos", F.round("mean", 6).alias("mean"), "n_vectors")


USABLE_SQL = """
usable AS MATERIALIZED (
  SELECT vec_id, embedding FROM (SELECT vec_id, embedding, row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at DESC NULLS LAST) AS n FROM vectors WHERE vec_id IS NOT NULL)
  WHERE n = 1 AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

QUERIES = {
    "p3_found": (p3_found, "SELECT cid FROM ivf_assignment WHERE cid >= 0 GROUP BY cid HAVING count(*) >= 0.04 * (SELECT count(*) FROM ivf_assignment)"),
    "p3_sizes": (p3_sizes, "SELECT cid, count(*) AS n_rows, round(count(*)::DOUBLE / (SELECT count(*) FROM ivf_assignment), 9) AS share FROM ivf_assignment WHERE cid >= 0 GROUP BY cid"),
    "p3_means": (
        p3_means,
        f"""WITH {USABLE_SQL},
members AS (SELECT DISTINCT cid, vec_id FROM ivf_assignment WHERE cid >= 0 AND vec_id IS NOT NULL),
elements AS (SELECT cid, unnest(embedding) AS x, unnest(range(128))::INTEGER AS pos FROM members JOIN usable USING (vec_id))
SELECT cid, pos, round(avg(x::DOUBLE), 6) AS mean, count(*) AS n_vectors FROM elements GROUP BY cid, pos""",
    ),
}
