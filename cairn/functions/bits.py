"""Columns over bit signatures kept in BIGINTs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def pack(bits: Column) -> Column:
    """An array of up to 64 booleans as a BIGINT, the first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def frequency_signature(low: Column) -> Column:
    """One bit for each of 64 low frequencies: above the median of all but the first (pHash's threshold step)."""
    rest = F.sort_array(F.slice(low, 2, 63))
    median = F.get(rest, F.lit(31))
    return F.transform(F.array(median), lambda m: pack(F.transform(low, lambda x: x > m)))[0]


def gradient_signature(values: Column) -> Column:
    """One bit for each value: the next one, the first after the last, is greater (dHash)."""
    n = F.size(values)
    return pack(F.transform(values, lambda v, i: F.get(values, (i + 1) % n) > v))


def row_gradient_signature(values: Column, width: int = 9) -> Column:
    """One bit for each value but the last of each row of a grid: its right neighbour is greater (dHash on 9 x 8)."""
    inner = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: i % width != width - 1)
    return pack(F.transform(inner, lambda i: F.get(values, i + 1) > F.get(values, i)))


def is_flat(pixels: Column, limit: float = 6.0) -> Column:
    """Whether a grid's values spread by less than ``limit``, as standard deviation."""
    total = lambda f: F.aggregate(pixels, F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / F.size(pixels)
    return F.sqrt(F.greatest(F.lit(0.0), total(lambda x: x * x) / F.size(pixels) - mean * mean)) < limit


def with_low_frequencies(df: DataFrame, pixels: str, out: str = "low") -> DataFrame:
    """``df`` with ``out`` in place of ``pixels``, square grids: the lowest 8 x 8 frequencies of their discrete cosine transforms, row by row."""
    keep = [f for f in df.schema if f.name != pixels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grids = np.stack([np.asarray(p, float) for p in batch[pixels]]) if len(batch) else np.zeros((0, 64))
            n = int(round(grids.shape[1] ** 0.5))
            waves = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
            waves[0] /= np.sqrt(2)
            low = (waves @ grids.reshape(-1, n, n) @ waves.T).reshape(len(grids), 64)
            yield batch.drop(columns=pixels).assign(**{out: list(low)})

    return df.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` array<double>"]))
