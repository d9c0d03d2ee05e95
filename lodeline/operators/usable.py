"""The current, usable row of every vector id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_usable(v: Column, dim: int) -> Column:
    """Not null, of ``dim`` elements, all finite and not null, not all zero."""
    inf = F.lit(float("inf")).cast("float")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame, dim: int = 128, id_col: str = "vec_id", vector: str = "embedding", order: str = "ingested_at") -> DataFrame:
    """``vec_id, embedding``: for each id the row with the latest ``order`` (a null one is the oldest; rows equal in it
    have equal content), if its vector is usable. Rows without an id are left out; other columns are dropped. One shuffle by id."""
    w = Window.partitionBy("vec_id").orderBy(F.col("__at").desc_nulls_last())
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("embedding"), F.col(order).alias("__at"))
    d = d.where(F.col("vec_id").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1)
    return d.where(is_usable(F.col("embedding"), dim)).select("vec_id", "embedding")
