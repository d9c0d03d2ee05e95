"""Mixing sources to target weights (problem 7).

Every source is cut into blocks by a hash of the record id, several for each output shard, so that all planning works on
(source, block) totals, and the records themselves never move for it.
Per source the wanted number of tokens becomes a quota of block draws: whole repeats, then blocks of one more repeat in
a random order while they fit. A splitting tree hands the quotas to the output shards: at each node the draws of
all sources are divided between the halves of the shards by a multivariate hypergeometric draw, so that each shard's
composition is that of a uniform shuffle of all draws without anyone making that shuffle. Each source's draws are then
permuted and dealt out as disjoint runs, and each shard orders its records locally.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.encode import count_tokens
from lodeline.plans.runtime import materialize

#: Blocks of a source, at least (how finely its last repeat can be cut), and for each output shard.
BLOCKS, BLOCKS_A_SHARD = 1024, 8
#: Tokens of the corpus for each output shard, where the number of shards isn't given (at least 16).
SHARD_TOKENS = 1 << 30


def source_key(c: Column) -> Column:
    """Lower case without white space around it; null stays null."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def block_of(doc_id: Column, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


@dataclass(frozen=True)
class Mixture:
    sizes: DataFrame  # doc_id, source, n_tokens
    report: DataFrame  # a row for each target
    draws: DataFrame  # mix_id, source, block, copy, shard: each block draw
    blocks: int


def sizes_of(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of every row, the source in its compared form."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return count_tokens(d, "text", ("doc_id", "source"), path)


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: the draws of each source that each shard gets. Shards differ by one draw at most, columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        left = total * (mid - lo) // (hi - lo)
        a = rng.multivariate_hypergeometric(q, left, method="marginals") if total else q * 0
        go(lo, mid, a)
        go(mid, hi, q - a)

    go(0, shards, np.asarray(quotas, np.int64))
    return out


def plan_mixtures(documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 7, blocks: int | None = None, path: str | None = None) -> Mixture:
    """Plan every mixture of ``targets`` (``mix_id, size_ratio, source, weight, max_repeats``).

    The target of a row is weight / (sum of its mix's weights) x size_ratio x tokens of all documents; documents of other or
    null sources count in that total only. A row whose weight is null, NaN or negative takes no part; a null size_ratio makes
    its targets null (nothing is drawn); null max_repeats counts as 0. Repeated rows of a source in a mix are planned each
    for itself. A source without documents, an empty table of documents or of targets give draws of nothing.

    report: ``mix_id, source, weight, max_repeats, source_tokens, target_tokens, target_share, actual_tokens, actual_share, max_repeat,
    short``; ``short`` says that all repeats of all blocks of the source were drawn, and stay below the target.

    Driver: it holds a total for each target (a table of settings) and block, and 8 bytes for each of the draws, which are the blocks times the repeats that a target takes. There are ``blocks`` of a
    source: BLOCKS, or BLOCKS_A_SHARD for each GB of tokens.
    """
    spark = documents.sparkSession
    t = targets.select("mix_id", "size_ratio", source_key(F.col("source")).alias("source"), F.col("weight").cast("double"), "max_repeats").collect()
    t = sorted((r for r in t if r.weight is not None and r.weight >= 0), key=lambda r: (r.mix_id is None, r.mix_id or 0, r.source is None, r.source or "", r.weight, r.max_repeats or 0))
    wanted = sorted({r.source for r in t if r.source is not None})
    sizes = materialize(sizes_of(documents, path), "sizes")
    key = F.when(F.col("source").isin(wanted), F.col("source")) if wanted else F.lit(None).cast("string")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = shards or max(16, math.ceil(total / SHARD_TOKENS))
    blocks = blocks or max(BLOCKS, BLOCKS_A_SHARD * shards)
    per_block = sizes.where(key.isNotNull()).groupBy(key.alias("source"), block_of(F.col("doc_id"), blocks).alias("block")).agg(F.sum("n_tokens").alias("tokens")).toArrow()
    own_source, own_block, own_tokens = per_block["source"].to_numpy(zero_copy_only=False), per_block["block"].to_numpy(), per_block["tokens"].to_numpy()
    tokens = {s: np.zeros(blocks, np.int64) for s in wanted}
    for s in wanted:
        at = own_source == s
        tokens[s][own_block[at]] = own_tokens[at]

    report, draws = [], []
    for mix in dict.fromkeys(r.mix_id for r in t):
        rows = [r for r in t if r.mix_id == mix]
        weights = sum(r.weight for r in rows)
        rng = np.random.default_rng([seed, (mix or 0) % 2**32])
        drawn = []
        for r in rows:
            own = tokens.get(r.source, np.zeros(blocks, np.int64))
            have, most = int(own.sum()), max(0, r.max_repeats or 0)
            share = r.weight / weights if weights else 0.0
            goal = share * r.size_ratio * total if r.size_ratio is not None else None
            whole = min(most, math.floor((goal or 0) / have)) if have else 0
            order = rng.permutation(np.flatnonzero(own))
            part = order[:0]
            if have and whole < most and goal:
                upto = np.cumsum(own[order])
                left = goal - whole * have
                n = int(np.searchsorted(upto, left, side="right"))
                if n < len(order) and upto[n] - left < left - (upto[n - 1] if n else 0):
                    n += 1  # the next block brings the sum nearer
                part = order[:n]
            drawn.append((np.concatenate([np.tile(order, whole), part]).astype(np.int32), np.concatenate([np.repeat(np.arange(whole), len(order)), np.full(len(part), whole)]).astype(np.int32)))
            got = whole * have + int(own[part].sum())
            short = r.max_repeats is not None and goal is not None and len(drawn[-1][0]) == most * len(order) and got < goal
            report.append([mix, r.source, r.weight, r.max_repeats, have, goal, share, got, None, whole + bool(len(part)), short])
        mixed = sum(x[7] for x in report[-len(rows) :])
        for x in report[-len(rows) :]:
            x[8] = x[7] / mixed if mixed else None
        quota = split_quotas(np.array([len(b) for b, _ in drawn]), shards, rng)
        for j, (r, (block, copy)) in enumerate(zip(rows, drawn)):
            o = rng.permutation(len(block))
            draws.append(pa.table({"mix_id": pa.array([mix] * len(o), pa.int64()), "source": pa.array([r.source] * len(o), pa.string()), "block": block[o], "copy": copy[o], "shard": np.repeat(np.arange(shards, dtype=np.int32), quota[:, j])}))
    id_type = targets.schema["mix_id"].dataType.simpleString()
    return Mixture(
        sizes,
        spark.createDataFrame(
            report,
            f"mix_id {id_type}, source string, weight double, max_repeats {targets.schema['max_repeats'].dataType.simpleString()}, source_tokens bigint, target_tokens double, target_share double, "
            "actual_tokens bigint, actual_share double, max_repeat int, short boolean",
        ),
        (spark.createDataFrame(pa.concat_tables(draws).combine_chunks()) if draws else spark.createDataFrame([], "mix_id bigint, source string, block int, copy int, shard int")).withColumn("mix_id", F.col("mix_id").cast(id_type)),
        blocks,
    )


def drawn_records(m: Mixture, seed: int = 7) -> DataFrame:
    """``mix_id, shard, pos, doc_id, source, copy, n_tokens``: every drawn record, pos its place in its shard. Records go once to their shard, of about
    SHARD_TOKENS, and are ordered there."""
    s = m.sizes.where(F.col("source").isNotNull()).withColumn("block", block_of(F.col("doc_id"), m.blocks))
    d = s.join(m.draws, ["source", "block"])
    w = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(seed), "mix_id", "doc_id", "copy"), "doc_id", "copy")
    return d.select("mix_id", "shard", F.row_number().over(w).alias("pos"), "doc_id", "source", "copy", "n_tokens")
