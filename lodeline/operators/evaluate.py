"""Recall and latency figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``qid, recall``: the share of the true neighbours that were found. Both: ``qid, vec_id``. A query of which nothing was found has 0."""
    t = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hit = truth.select("qid", "vec_id").join(found.select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hit"))
    return t.join(hit, "qid", "left").select("qid", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def percentiles(values: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """``p50, p99, ...`` interpolated between the two elements around (n - 1) x p, nulls left out; null if there are none. By counts, so no task holds the values."""
    n = values.where(F.col(column).isNotNull()).count()
    out = []
    for p in at:
        place = (n - 1) * p
        low, high = ([r[0] for r in element(values, column, n, i).collect()] if n else [] for i in (math.floor(place), math.ceil(place)))
        out.append(float(low[0] + (high[0] - low[0]) * (place - math.floor(place))) if n else None)
    return values.sparkSession.createDataFrame([tuple(out)], ", ".join(f"p{round(p * 100)} double" for p in at))


def percentile_index(values: DataFrame, column: str, p: int) -> DataFrame:
    """``value``: the element at min(n - 1, floor(n x p / 100)) of the ascending values (no row if there are none)."""
    n = values.where(F.col(column).isNotNull()).count()
    return element(values, column, n, min(n - 1, n * p // 100))


def element(values: DataFrame, column: str, n: int, at: int) -> DataFrame:
    """``value``: the one at place ``at`` of the n ascending values that are not null. Counted by value, then by bins, which get finer around the place, so no task sorts the rows."""
    c = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    low, high = (x if x is not None else 0 for x in c.agg(F.min("value"), F.max("value")).first())
    bins = F.least(F.lit(1023), F.floor(F.try_divide(F.col("value") - low, F.lit(float(high - low))) * 1024)) if n else F.lit(0)
    c = c.withColumn("bin", F.coalesce(bins, F.lit(0)))
    before, hit = 0, 0
    for r in c.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():  # 1024 rows at most
        if before + r.n > at:
            hit = r.bin
            break
        before += r.n
    inside = c.where(F.col("bin") == hit)
    for _ in range(8):  # finer bins within the one that is hit, until it holds few values
        low, high, many = inside.agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
        if many <= 4096 or not high > low:
            break
        finer = inside.withColumn("bin", F.least(F.lit(1023), F.floor((F.col("value") - low) / float(high - low) * 1024)))
        for r in finer.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():
            if before + r.n > at:
                hit = r.bin
                break
            before += r.n
        inside = finer.where(F.col("bin") == hit)
    inside = inside.withColumn("upto", F.sum("n").over(Window.orderBy("value")) + before)
    return inside.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select("value")
