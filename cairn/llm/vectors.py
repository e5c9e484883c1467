"""Vectors as packed integers: what reads them once, so that later passes move small binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import tidy

#: A packed component is four bytes.
LIMIT = 1 << 31


def usable(df: DataFrame, vector: str) -> DataFrame:
    """``df`` without rows whose ``vector`` is null or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def packed(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """``df`` with ``q`` (little-endian 32-bit integers floor(scale * x)) and ``dim`` in place of ``vector``; unusable rows go.

    A component beyond 2^31 / scale is an error: sums of its squares wouldn't fit 64 bits.
    """
    keep = [f for f in df.schema if f.name != vector]
    given = usable(df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(vector).cast("array<double>").alias("_v")), "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            at = column.offsets.to_numpy()
            values = np.floor(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] * scale)
            if len(values) and np.abs(values).max() >= LIMIT:
                raise ValueError(f"a component times {scale} is beyond 32 bits")
            q = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(values.astype("<i4"))])
            dims = pa.array(np.diff(at), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], q, dims], [*[f.name for f in keep], "q", "dim"])

    return given.mapInArrow(tidy(run), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "q binary", "dim int"]))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers; shorter ones end in zeros."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    values = np.frombuffer(column.buffers()[2], "<i4")[at[0] : at[-1]] if len(column) and at[-1] > at[0] else np.empty(0, "<i4")
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < np.diff(at)[:, None]] = values
    return out
