"""Encoding of texts into token ids (problem 6), and token counts."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeline.llm.bytebpe import ByteBPE

_loaded: dict[str, ByteBPE] = {}


def default_vocabulary() -> str:
    """The ranks of byte_bpe_50k among the machine's public tokenizers."""
    if spec := importlib.util.find_spec("public_tokenizers"):
        return os.path.join(os.path.dirname(spec.origin), "byte_bpe_50k.tiktoken")
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def tokenizer(path: str) -> ByteBPE:
    """One per worker process, so that its cache of merged slices serves all tasks."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))


def _apply(df: DataFrame, text: str, keep: list[str], extra: list[T.StructField], path: str | None, make) -> DataFrame:
    path = path or default_vocabulary()
    base = df.select(*keep, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            flat, counts = bpe.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *make(bpe, flat, counts)], [*keep, *(f.name for f in extra)])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *extra]))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """``keep`` columns, and ``ids`` (array<int>) of the column ``text`` without special tokens, whose strings are
    ordinary text. A null or empty text has the empty list. ``with_offsets`` adds ``offsets``: where in the text's
    UTF-8 bytes each id begins. Other columns of any name don't matter; rows stay as they are, repeated ones too.
    Narrow: one pass over the scan, no shuffle."""
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    if not with_offsets:
        return _apply(df, text, list(keep), [ids], path, lambda bpe, flat, counts: [_lists(flat, counts)])

    def make(bpe: ByteBPE, flat: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        size = np.fromiter((len(bpe.bytes_of[i]) for i in range(len(bpe.bytes_of))), np.int64)[flat]
        before = np.cumsum(size) - size
        first = np.cumsum(counts) - counts
        base = np.repeat(before[np.minimum(first, max(len(flat) - 1, 0))] if len(flat) else first, counts)
        return [_lists(flat, counts), _lists((before - base).astype(np.int32), counts)]

    return _apply(df, text, list(keep), [ids, T.StructField("offsets", T.ArrayType(T.IntegerType()))], path, make)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """As ``encode``, but the number of ids only (0 for a null or empty text)."""
    return _apply(df, text, list(keep), [T.StructField(name, T.LongType())], path, lambda bpe, flat, counts: [pa.array(counts, pa.int64())])


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The texts again, as ``text``; a null list gives null."""
    path = path or default_vocabulary()
    base = df.select(*keep, df[ids].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("text", T.StringType())]))
