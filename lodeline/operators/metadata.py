"""Metadata and ids: enrichment, lookups, deletes and checks, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(metadata: str, ext_id: str) -> Column:
    """The JSON text with ``__id__`` set to the id, keys in order. What is no JSON counts as an empty object; JSON that is no object stays as it is."""
    m, i = f"`{metadata}`", f"cast(`{ext_id}` as string)"
    asmap = f"from_json({m}, 'map<string,variant>')"
    return F.expr(
        f"""CASE WHEN try_parse_json({m}) IS NOT NULL AND schema_of_variant(try_parse_json({m})) NOT LIKE 'OBJECT%' THEN to_json(try_parse_json({m}))
        ELSE to_json(map_from_entries(array_sort(map_entries(map_concat(
          map_filter(coalesce(CASE WHEN try_parse_json({m}) IS NOT NULL THEN {asmap} END, cast(map() as map<string,variant>)), (k, v) -> k <> '__id__'), map('__id__', cast({i} AS variant)))),
          (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END))) END"""
    )


def get_batch(request: DataFrame, metadata: DataFrame) -> DataFrame:
    """``ord, vec_id, metadata`` in the order of ``ord``, null where an id has none. request: ``ord, vec_id`` (ids may repeat)."""
    return request.join(metadata.select("vec_id", "metadata"), "vec_id", "left").select("ord", "vec_id", "metadata").orderBy("ord")


def get(ids: DataFrame, metadata: DataFrame, ext_id: str) -> DataFrame:
    """``ext_id, vec_id, metadata`` of one id: no row if it is unknown, null metadata if it has none."""
    return ids.where(F.col("ext_id") == ext_id).join(metadata.select("vec_id", "metadata"), "vec_id", "left").select("ext_id", "vec_id", "metadata")


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``ids``. A null key is in nothing."""
    return rows.join(ids.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """``key, n`` of the ids that occur more than once; null ids don't count."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def already_stored(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return new.select(key).join(stored.select(key), key, "left_semi")


def wrong_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """``vec_id, actual, expected`` of the rows whose vector has another length; a null one has length -1."""
    n = F.coalesce(F.when(F.col("embedding").isNull(), F.lit(-1)).otherwise(F.size("embedding")), F.lit(-1))
    return vectors.select("vec_id", n.alias("actual"), F.lit(dim).alias("expected")).where(F.col("actual") != dim)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return delete(old, new, key).unionByName(new)
