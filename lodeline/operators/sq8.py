"""8-bit scalar quantisation: a minimum and maximum per dimension, one byte per element."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.exact import batch_topk

#: Ranges below this are empty: their code is 0.
TINY = 1e-10


def train(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``pos, mn, mx``. Combined in the tasks: a task sends ``dim`` rows. Null vectors are left out; ragged or no vectors raise ValueError
    where ``dim`` is given."""
    v = vectors.where(F.col("embedding").isNotNull())
    if dim is not None:
        n, bad = v.agg(F.count(F.lit(1)), F.sum((F.size("embedding") != dim).cast("int"))).first()
        if not n:
            raise ValueError("training needs at least one vector")
        if bad:
            raise ValueError(f"{bad} training vectors don't have {dim} dimensions")
    x = v.select(F.posexplode("embedding").alias("pos", "x"))
    return x.groupBy("pos").agg(F.min("x").cast("double").alias("mn"), F.max("x").cast("double").alias("mx"))


def _model(model: DataFrame) -> tuple[list[float], list[float]]:
    rows = model.orderBy("pos").collect()  # one row per dimension
    return [r.mn for r in rows], [r.mx for r in rows]


def encode(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """``vec_id, codes`` (array<smallint>): (x - min) / range x 255 within 0..255, without its fraction. The model is part of the expression, so
    this is a projection of the scan."""
    mn, mx = _model(model)
    lo, hi = F.array(*map(F.lit, mn)), F.array(*map(F.lit, mx))
    scaled = F.zip_with(F.zip_with(F.col("embedding").cast("array<double>"), lo, lambda x, m: x - m), F.zip_with(hi, lo, lambda a, b: a - b), lambda x, r: F.when(r < TINY, F.lit(0.0)).otherwise(F.try_divide(x, r) * 255))
    codes = F.transform(scaled, lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))).cast("smallint"))
    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", codes.alias("codes"))


def decode(codes: DataFrame, model: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (array<double>): min + code / 255 x range."""
    mn, mx = _model(model)
    lo, hi = F.array(*map(F.lit, mn)), F.array(*map(F.lit, mx))
    span = F.zip_with(hi, lo, lambda a, b: a - b)
    x = F.zip_with(F.zip_with("codes", span, lambda c, r: c / 255.0 * r), lo, lambda y, m: y + m)
    return codes.select("vec_id", x.alias("embedding"))


def search(codes: DataFrame, model: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``batch_topk``: full-precision queries against decoded codes, by the plain cosine (-1..1). Codes are decoded a batch at a time."""
    mn, mx = map(np.array, _model(model))
    return batch_topk(codes.select("vec_id", F.col("codes").alias("embedding")), queries, k, "raw", lambda c: mn + c / 255.0 * (mx - mn))


def error(vectors: DataFrame, decoded: DataFrame) -> DataFrame:
    """``mean_error, max_error`` of the elements."""
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("a")).join(decoded.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    x = d.select(F.explode(F.zip_with("a", "b", lambda a, b: F.abs(a - b))).alias("e"))
    return x.agg(F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))
