"""Vector code compression: product codes whose nearest entries are found by equal-average search.

A squared distance in k dimensions is at least the squared gap of the component sums over k. So
entries are sorted by their sums, and each part's search goes outward from its own sum until that
bound is strictly beyond the best distance: what is left can be neither nearer nor a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.vectors import matrix, packed
from cairn.llm.words import tidy
from cairn.session import bounded_batches, join_counted, materialize

#: Parts that are searched at a time, for the size of what is in between.
ROWS = 1 << 16


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest row of ``entries`` (ties: the lower index) and its squared distance.

    Each step takes, for all rows still at work, the entry next in order of sums on the side with the smaller gap.
    """
    n, k = parts.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = parts.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    far = np.iinfo(np.int64).max // max(k, 1)
    best, found = np.full(n, far), np.full(n, len(entries))
    rows = np.arange(n)
    while len(rows):
        l, r, s = left[rows], right[rows], own[rows]
        below = np.where(l >= 0, s - sums[np.maximum(l, 0)], far)
        above = np.where(r < len(sums), sums[np.minimum(r, len(sums) - 1)] - s, far)
        down = below <= above
        gap = np.minimum(below, above)
        # a gap's square may pass 64 bits only where it is the mark for "none left"
        on = gap < far
        on[on] = gap[on] ** 2 <= best[rows[on]] * k
        rows, down = rows[on], down[on]
        entry = order[np.where(down, left[rows], right[rows])]
        left[rows] -= down
        right[rows] += ~down
        distance = ((parts[rows] - entries[entry]) ** 2).sum(1)
        won = (distance < best[rows]) | ((distance == best[rows]) & (entry < found[rows]))
        best[rows[won]], found[rows[won]] = distance[won], entry[won]
    return found, best


class Codebooks:
    """Entries by part: an array (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, a column a part."""
        m, _, width = self.entries.shape
        codes, errors = np.zeros((len(vectors), m), np.int64), np.zeros((len(vectors), m), np.int64)
        for a in range(0, len(vectors), ROWS):
            for p in range(m):
                codes[a : a + ROWS, p], errors[a : a + ROWS, p] = nearest(vectors[a : a + ROWS, p * width : (p + 1) * width], self.entries[p])
        return codes, errors

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that ``codes`` (a column a part) stand for."""
        m, _, width = self.entries.shape
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(m)], axis=1) if len(codes) else np.zeros((0, m * width), np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _moved(q: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """One round: every task sums the parts of each entry, Spark adds the sums up; what comes to the driver has the books' own size."""
    m, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((m, k, width), np.int64), np.zeros((m, k), np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), dim)
            codes, _ = books.assign(vectors)
            for p in range(m):
                np.add.at(totals[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        at = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals.ravel()[at]), pa.array(np.repeat(counts.ravel(), width)[at])], ["at", "total", "n"])

    sums = q.select("q").mapInArrow(tidy(run), "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy().ravel()
    for at, total, n in sums.collect():  # no more rows than the books have numbers
        entries[at] = total // n
    return Codebooks(entries.reshape(m, k, width))


def fit(q: DataFrame, first: list[np.ndarray], parts: int, rounds: int, dim: int) -> Codebooks:
    """Codebooks over all of ``q``, from the vectors ``first``; an entry that no part is nearest to stays as it is."""
    start = np.stack([v.reshape(parts, dim // parts) for v in first], axis=1) if first else np.zeros((parts, 0, dim // parts), np.int64)
    books = Codebooks(start)
    for _ in range(rounds if first else 0):
        books = _moved(q, books, dim)
    return books


def compress(vectors: DataFrame, scale: float = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, code, error)`` of every usable row of ``vectors`` (vec_id, embedding, label), and the codebooks.

    Components become floor(scale * x), exactly; all that follows is in integers. Books start at the
    rows with the smallest ids (nulls last; rows of one id in order of their bytes). With fewer rows than ``entries`` there are as many
    entries as rows; an empty table gives no rows and empty books. Rows whose vector is null or
    holds null or non-finite components go. Vectors end in zeros up to the longest one's length, and up to the
    next multiple of ``parts``. Repeated rows count as often as they stand there. Other columns aren't read.
    Components so large that squared distances could pass 64 bits are an error.

    The rows are packed once into the shared folder; each round reads that column only. A round's
    shuffle has a task's sums, ``entries`` numbers a dimension, and so does what reaches the driver.
    """
    bounded_batches(vectors.sparkSession)
    q = materialize(packed(vectors.select("vec_id", "label", "embedding"), "embedding", scale), "packed")
    longest = q.agg(F.max("dim")).first()[0] or 0
    dim = max(1, -(-longest // parts)) * parts
    first = q.orderBy(F.asc_nulls_last("vec_id"), "q", "label").select("q").limit(entries).collect()
    first = list(matrix(pa.array([bytes(r.q) for r in first], pa.binary()), dim)) if first else []
    peak = _largest(q)
    if (dim * (2 * peak + 2)) ** 2 >= 1 << 63:
        raise ValueError("components are so large that squared distances pass 64 bits")
    books = fit(q, first, parts, rounds, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assign(matrix(batch.column(2), dim))
            text = codes.astype(np.uint8).tobytes().hex()
            code = pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(batch))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], code, pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    kind = {f.name: f.dataType.simpleString() for f in q.schema}
    coded = q.select("vec_id", "label", "q").mapInArrow(tidy(run), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")
    return materialize(coded, "codes"), books


def _largest(q: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            column = batch.column(0)
            n = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset + len(column)]) // 4 if len(column) else 0
            most = max([most, *(int(np.abs(x.astype(np.int64)).max()) for x in ([np.frombuffer(column.buffers()[2], "<i4")[:n]] if n else []))])
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return q.select("q").mapInArrow(tidy(run), "most long").agg(F.max("most")).first()[0] or 0


def code_report(vectors: DataFrame, **settings) -> DataFrame:
    """``compress``'s rows as ``(vec_id, code, error, label_error, codebooks_sha256)``; null labels count as one."""
    coded, books = compress(vectors, **settings)
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = materialize(named.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    total = by_label.agg(F.sum("_n")).first()[0] or 0
    out = join_counted(named.select("vec_id", "code", "error", "_label"), by_label, "_label", "_n", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
