"""Queries that go through a collection, its tables and its indexes: rows are added, changed, deleted and searched, and the folder is opened again. The rows are the usable
vectors of the ``vectors`` table, in the order of their ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.collection import Collection
from lodeline.operators.usable import usable
from lodeline.plans.row_queries import GONE, _deleted
from lodeline.plans.runtime import materialize, read, shared_dir
from lodeline.plans.search_queries import COS, K, _r, _top
from lodeline.plans.strategy import AutoTunerConfig

DIM = 128


def _rows(spark: SparkSession, d: str) -> DataFrame:
    v = usable(read(spark, d, "vectors"), DIM)
    return v.select("vec_id", F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("ext_id"), "embedding", F.format_string('{"n":%d}', "vec_id").alias("metadata"))


def _filled(spark: SparkSession, d: str, mode: str = "flat", half: bool = False, **kw) -> tuple[Collection, DataFrame]:
    """A new collection that holds all rows (in two parts, of even and odd ids, if ``half``), and the rows."""
    c, rows = Collection(f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", DIM, mode, spark=spark, **kw), _rows(spark, d)
    for part in (rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 <> 0")) if half else (rows,):
        c.add(part.orderBy("vec_id"))
        if half:
            c._ensure(c.effective_mode())  # the second part is appended to an index that is there
    return c, rows


def _again(c: Collection) -> Collection:
    c.close()
    return Collection(c.store.path, DIM, spark=c.spark)


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "rk", "ext_id", _r("score").alias("score"))


def collection_search(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d)
    return _hits(_again(c).search_batch_df(_queries(rows), K))


def collection_metadata_of_hits(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d)
    found = _again(c).search_batch_df(_queries(rows), 3)
    return found.select("qid", "rk", F.get_json_object("metadata", "$.__id__").alias("id"), F.get_json_object("metadata", "$.n").cast("long").alias("n"))


def collection_delete(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d)
    c.delete(rows.join(_deleted(spark, d), "vec_id", "left_semi"))
    return _hits(_again(c).search_batch_df(_queries(rows), K))


def collection_readd(spark: SparkSession, d: str) -> DataFrame:
    """Some ids are deleted; the even ones come again, with other metadata."""
    c, rows = _filled(spark, d)
    gone = rows.join(_deleted(spark, d), "vec_id", "left_semi")
    c.delete(gone)
    c = _again(c)
    c.add(gone.where("vec_id % 2 = 0").withColumn("metadata", F.lit('{"n":-1}')))
    return _again(c)._live().select("ext_id", F.get_json_object("metadata", "$.n").cast("long").alias("n"))


def collection_sq8(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d, "sq8")
    return _hits(_again(c).search_batch_df(_queries(rows), K))


def collection_ivf(spark: SparkSession, d: str) -> DataFrame:
    """All cells are probed, so the result is the exact one; half of the rows were added after the training."""
    c, rows = _filled(spark, d, "ivf")
    c.configure_ivf(8, 8, 3)
    c.train_ivf()
    return _hits(_again(c).search_batch_df(_queries(rows), K))


def collection_auto(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d, "auto", tuner=AutoTunerConfig(16.0, 10**9))
    return _hits(c.search_batch_df(_queries(rows), K))


def collection_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search of modes hnsw and ivf reaches a mean recall of 0.9 against mode flat, on a collection that was filled in two parts. All search the same collection, whose true neighbours are found once."""
    c, rows = _filled(spark, d, "hnsw", half=True)
    q = materialize(_queries(rows), "queries")
    found = {"hnsw": materialize(c.search_batch_df(q, K).select("qid", "ext_id"), "found")}
    c.set_mode("ivf")
    c.configure_ivf(16, 8, 5)
    c.train_ivf()
    found["ivf"] = materialize(c.search_batch_df(q, K).select("qid", "ext_id"), "found")
    c.set_mode("flat")
    truth = materialize(c.search_batch_df(q, K).select("qid", "ext_id"), "truth")
    out = None
    for mode, some in found.items():
        hit = truth.join(some.distinct(), ["qid", "ext_id"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
        r = truth.agg(F.count(F.lit(1)).alias("n")).crossJoin(hit).select(F.lit(mode).alias("mode"), (F.col("hit") >= 0.9 * F.col("n")).alias("reached"))  # a row each
        out = r if out is None else out.union(r)
    return out


def collection_range(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d)
    r = _again(c).get_range(100, 50)
    return r.select(F.col("vec_id").alias("row"), _r(F.element_at("embedding", 1).cast("double")).alias("first"))


def collection_codes(spark: SparkSession, d: str) -> DataFrame:
    """The codes of a range of rows in mode sq8, their elements added up."""
    c, rows = _filled(spark, d, "sq8", half=True)
    return _again(c).get_codes(0, 50, "sq8").select(F.col("vec_id").alias("row"), F.aggregate("codes", F.lit(0), lambda s, x: s + x).alias("total"))


def collection_set_metadata(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d)
    c.set_metadata(rows.where("vec_id % 3 = 0").select("ext_id", F.lit('{"n":-3}').alias("metadata")))
    c.set_metadata(rows.where("vec_id % 9 = 0").select("ext_id", F.lit("no json").alias("metadata")))
    live = _again(c)._live()
    return live.select("ext_id", F.get_json_object("metadata", "$.__id__").alias("id"), F.get_json_object("metadata", "$.n").cast("long").alias("n"))


def collection_info(spark: SparkSession, d: str) -> DataFrame:
    c, rows = _filled(spark, d, "sq8")
    gone = c.delete(rows.join(_deleted(spark, d), "vec_id", "left_semi"))
    c = _again(c)
    i = c.info()
    return spark.createDataFrame([(i["dimension"], i["mode"], i["count"], gone, c.metadata_count(), c.get_all_ids().count())], "dimension int, mode string, n bigint, n_deleted bigint, n_metadata bigint, n_ids bigint")


USABLE = """u AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM (SELECT vec_id, embedding, row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at DESC NULLS LAST) AS n FROM vectors WHERE vec_id IS NOT NULL)
  WHERE n = 1 AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM u),
q AS MATERIALIZED (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 20 = 0)"""


def _found(source: str = "q CROSS JOIN e", score: str = COS, k: int = K, more: str = "", out: str = "qid, rk, 'v-' || vec_id AS ext_id, round(sc, 6) AS score") -> str:
    """Of equal scores the row that was added first comes first, and rows were added in the order of their ids."""
    return f"WITH {USABLE}{more}, {_top(score, out, source, k)}"


SQ8 = """, x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(len(v)))::INTEGER AS pos FROM e),
model AS MATERIALIZED (SELECT pos, min(x) AS mn, max(x) AS mx FROM x GROUP BY pos),
codes AS MATERIALIZED (SELECT vec_id, pos, mn, mx, CASE WHEN mx - mn < 1e-10 THEN 0 ELSE floor(greatest(0, least(255, (x - mn) / (mx - mn) * 255)))::INTEGER END AS code FROM x JOIN model USING (pos)),
dv AS MATERIALIZED (SELECT vec_id, list(mn + code / 255.0::DOUBLE * (mx - mn) ORDER BY pos) AS v FROM codes GROUP BY vec_id)"""
LEFT = "q CROSS JOIN (SELECT * FROM e ANTI JOIN gone USING (vec_id))"
QUERIES = {
    "collection_search": (collection_search, _found()),
    "collection_metadata_of_hits": (collection_metadata_of_hits, _found(k=3, out="qid, rk, 'v-' || vec_id AS id, vec_id AS n")),
    "collection_delete": (collection_delete, _found(LEFT, more=", " + GONE)),
    "collection_readd": (collection_readd, f"WITH {USABLE}, {GONE} SELECT 'v-' || e.vec_id AS ext_id, CASE WHEN gone.vec_id IS NULL THEN e.vec_id ELSE -1 END AS n FROM e LEFT JOIN gone USING (vec_id) WHERE gone.vec_id IS NULL OR e.vec_id % 2 = 0"),
    "collection_sq8": (collection_sq8, _found("q CROSS JOIN dv", "list_cosine_similarity(qv, v)", more=SQ8)),
    "collection_ivf": (collection_ivf, _found()),
    "collection_auto": (collection_auto, _found()),
    "collection_recall": (collection_recall, "SELECT unnest(['hnsw', 'ivf']) AS mode, true AS reached"),
    "collection_range": (collection_range, f"WITH {USABLE} SELECT row, round(v[1], 6) AS first FROM e WHERE row BETWEEN 100 AND 149"),
    "collection_codes": (collection_codes, None),
    "collection_set_metadata": (collection_set_metadata, f"WITH {USABLE} SELECT 'v-' || vec_id AS ext_id, 'v-' || vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN -3 ELSE vec_id END AS n FROM e"),
    "collection_info": (collection_info, f"WITH {USABLE}, {GONE} SELECT 128 AS dimension, 'sq8' AS mode, count(*) FILTER (WHERE gone.vec_id IS NULL) AS n, count(gone.vec_id) AS n_deleted, count(*) FILTER (WHERE gone.vec_id IS NULL) AS n_metadata, count(*) FILTER (WHERE gone.vec_id IS NULL) AS n_ids FROM e LEFT JOIN gone USING (vec_id)"),
}
