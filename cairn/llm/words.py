"""Words and their 64-bit hashes, vectorised over the buffers of Arrow text columns.

A word is a run of bytes outside space and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over its bytes: with running sums over a block of text, each word costs two lookups.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTES[65:91] = _BYTES[97:123]
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 62, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
#: Bytes of text that are worked on at once; a block ends with a word, so only a longer word makes it longer.
BLOCK = 1 << 20


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which freed memory goes back to the system: a stage's workers stay on, idle, beside those of the next."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the GNU C library's; others do without
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return through


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, _U)
    a[0] = 1
    return np.multiply.accumulate(a)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """Made where texts are read: the driver, which imports this too, does without their 32 MB."""
    return [_power_table(base, 2 * BLOCK) for base in (_P, _P_INV)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers up to ``n``; those beyond two blocks are made for one use and not kept."""
    return _powers() if n <= 2 * BLOCK else [_power_table(base, n) for base in (_P, _P_INV)]


def _block_bounds(data: np.ndarray) -> list[tuple[int, int]]:
    n, bounds, a = len(data), [], 0
    while n - a > 2 * BLOCK:
        b = a + BLOCK
        while b < n and not len(gap := np.flatnonzero(_SEP[data[b : b + BLOCK]])):
            b += BLOCK
        b = n if b >= n else b + int(gap[0]) + 1
        bounds.append((a, b))
        a = b
    return [*bounds, (a, n)] if n > a or not bounds else bounds


class Words:
    """The words of some texts: ``hashes``, byte bounds ``starts``/``ends``, and ``bounds`` by text.

    Per byte of text a long text costs what its words do, some 24 bytes a word; all else is held by block.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self._data, self._offsets = data, offsets
        self._blocks = _block_bounds(data)
        self._only = None
        found = []
        for a, b in self._blocks:
            block = self._scan(a, b)
            found.append((block[0] + a, block[1] + a, self._hashed(block, 1 << 40)))
        if len(found) == 1:
            self._only = block
        self.starts, self.ends, self.hashes = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*found, strict=True))
        self.bounds = np.searchsorted(self.starts, offsets)

    def _scan(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and running sums of a block."""
        data, n = self._data[a:b], b - a
        sep = _SEP[data]
        edge = np.zeros(n + 1, bool)
        inside = self._offsets[np.searchsorted(self._offsets, a) : np.searchsorted(self._offsets, b, "right")]
        edge[inside - a] = True
        before = np.ones(n, bool)
        before[1:] = sep[:-1]
        after = np.ones(n, bool)
        after[:-1] = sep[1:]
        starts = np.flatnonzero(~sep & (before | edge[:-1]))
        ends = np.flatnonzero(~sep & (after | edge[1:])) + 1
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTES[data] * _tables(n + 1)[0][:n], out=sums[1:])
        return starts, ends, sums

    @staticmethod
    def _hashed(block: tuple[np.ndarray, np.ndarray, np.ndarray], n_bytes: int) -> np.ndarray:
        starts, ends, sums = block
        ends = np.minimum(ends, starts + n_bytes)
        h = (sums[ends] - sums[starts]) * _tables(len(sums))[1][starts]
        return mix(h + (ends - starts).astype(_U))

    def by_block(self, *limits: int) -> Iterator[list[np.ndarray]]:
        """Block by block, hashes of each word's first so many bytes, one array a limit."""
        for a, b in self._blocks:
            block = self._only or self._scan(a, b)
            yield [self._hashed(block, min(n, 1 << 40)) for n in limits]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` successive values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    total = np.zeros(m, _U)
    for k in range(n):
        total += hashes[k : k + m] * _STEP[k]
    return mix(total + _STEP[32 + n])


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word runs; the whole text if it has fewer."""
    runs = chain(words.hashes, n)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        yield np.unique(runs[a : b - n + 1]) if b - a >= n else chain(words.hashes[a:b], b - a) if b > a else runs[:0]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def portions(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over ``column``, each about ``size`` bytes or one longer text: bounds working memory."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
