"""The N best items of every group (problem 4), by simultaneous bisection of all groups' cutoffs.

An item's code is (score bits mapped to an integer of the same order, complement of the id), so a greater code is a better item and no
two items of a group are equal. A round counts, for all unfinished groups at once, the rows in each of 256 equal parts of the
group's bracket and moves the bracket to the part that holds the N-th best code. Only the rows inside brackets go to the next round, so
the work falls about 256-fold each time; no group is ever sorted or gathered: groups of a hundredth of all rows or more stay where their rows are, and only their brackets move. When a bracket has shrunk to one score, the same goes on
over the ids. A round's counts are combined before they are shuffled, so a group of any size is a few rows per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators.skew import HEAVY_SHARE
from lodeline.plans.runtime import materialize

#: Bits of the code settled in a round.
BITS = 8


def ordered_code(score: pa.Array) -> pa.Array:
    """int64 in the order of the doubles; -0.0 equals 0.0. Null stays null."""
    x = score.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bits = x.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), pa.int64(), mask=score.is_null().to_numpy(zero_copy_only=False))


def valid_items(results: DataFrame) -> DataFrame:
    """``qid, vec_id, score``: of each (qid, vec_id) the row received last (a null time is the oldest; of several at that
    time the greatest score, NaN being greatest and null least), if its score is neither null nor NaN. Rows with a null
    qid or vec_id are no items."""
    d = results.where("qid is not null and vec_id is not null").select("qid", "vec_id", "received_at", F.col("score").cast("double").alias("score"))
    d = d.groupBy("qid", "vec_id").agg(F.max(F.struct("received_at", "score")).alias("r")).select("qid", "vec_id", "r.score")
    return d.where(F.col("score").isNotNull() & ~F.isnan("score"))


def _bits(lo: Column, hi: Column) -> Column:
    """Bits in which two codes can differ: 0 if they are equal."""
    return F.when(lo == hi, F.lit(0)).otherwise(F.length(F.bin(lo.bitwiseXOR(hi))))


def _shifted(code: Column, by: Column) -> Column:
    return F.call_function("shiftright", code, by)


def _tighten(state: DataFrame) -> DataFrame:
    """A bracket of a single score goes on as the bracket of its rows' ids."""
    tied = F.col("cut").isNull() & (F.col("lo") == F.col("hi"))
    return state.select("qid", "need", F.when(tied, F.col("id_lo")).otherwise(F.col("lo")).alias("lo"), F.when(tied, F.col("id_hi")).otherwise(F.col("hi")).alias("hi"), F.when(tied, F.col("lo")).otherwise(F.col("cut")).alias("cut"))


def _by_group(rows: DataFrame, few: DataFrame, heavy: list, how: str = "inner") -> DataFrame:
    """A join by qid whose heavy groups don't move: their rows of ``few`` (one for each, so at most as many as ``heavy``) go to all tasks; the light groups are shuffled."""
    if not heavy:
        return rows.join(few, "qid", how)
    own = F.col("qid").isin(heavy)
    return rows.where(own).join(F.broadcast(few.where(own)), "qid", how).union(rows.where(~own).join(few.where(~own), "qid", how))


def top_n(items: DataFrame, n: int = 10) -> DataFrame:
    """``qid, vec_id, score`` of the n items with the highest score in each qid (all, if fewer), ties by smaller vec_id.

    items: ``qid, vec_id, score`` without nulls, NaN or repeated (qid, vec_id); ``valid_items`` gives that. n < 1 gives no rows."""
    if n < 1:
        return items.select("qid", "vec_id", "score").limit(0)
    code = F.arrow_udf(ordered_code, "bigint")
    base = materialize(items.select("qid", "vec_id", "score", code("score").alias("s"), F.bitwise_not("vec_id").alias("i")), "items")
    # A bracket [lo, hi] is one of scores while cut is null, then one of ids at the score cut; need of its rows are taken.
    ends = [F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("i").alias("id_lo"), F.max("i").alias("id_hi")]
    state = materialize(base.groupBy("qid").agg(F.count(F.lit(1)).alias("c"), *ends).where(F.col("c") > n), "groups")
    groups = state
    state = _tighten(state.withColumns({"need": F.lit(n).cast("long"), "cut": F.lit(None).cast("long")}))
    # Groups of a hundredth of all rows or more: at most a hundred.
    heavy = [r.qid for r in groups.where(F.col("c") >= max(1, HEAVY_SHARE * base.count())).select("qid").collect()]
    code_col = F.when(F.col("cut").isNull(), F.col("s")).otherwise(F.col("i"))
    active, found = base.select("qid", "s", "i"), []
    while True:
        rows = _by_group(active, state, heavy).where(code_col.between(F.col("lo"), F.col("hi")) & (F.col("cut").isNull() | (F.col("s") == F.col("cut"))))
        shift = F.greatest(F.lit(0), _bits(F.col("lo"), F.col("hi")) - BITS).cast("int")
        rows = materialize(rows.select("qid", "s", "i", "need", "cut", _shifted(code_col, shift).alias("part")), "bracket")
        ends = [F.min(code_col).alias("lo"), F.max(code_col).alias("hi"), F.min("i").alias("id_lo"), F.max("i").alias("id_hi")]
        counts = rows.groupBy("qid", "need", "cut", "part").agg(F.count(F.lit(1)).alias("c"), *ends)
        upto = F.sum("c").over(Window.partitionBy("qid").orderBy(F.desc("part")))
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        hit = materialize(hit.withColumn("need", F.col("need") - F.col("upto") + F.col("c")).drop("upto", "part"), "cutoffs")
        done = F.col("c") == F.col("need")
        found.append(hit.where(done).select("qid", F.coalesce("cut", "lo").alias("cut_s"), F.when(F.col("cut").isNotNull(), F.col("lo")).alias("cut_i")))
        state, active = _tighten(hit.where(~done)), rows.select("qid", "s", "i")
        if state.isEmpty():
            break
    cutoffs = found[0]
    for f in found[1:]:
        cutoffs = cutoffs.union(f)
    above = (F.col("s") > F.col("cut_s")) | ((F.col("s") == F.col("cut_s")) & (F.col("cut_i").isNull() | (F.col("i") >= F.col("cut_i"))))
    return _by_group(base, materialize(cutoffs, "cutoffs"), heavy, "left").where(F.col("cut_s").isNull() | above).select("qid", "vec_id", "score")
