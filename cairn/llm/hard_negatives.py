"""Hard negatives: rows of other labels that score a little below an anchor's positives.

Candidates lie in Parquet blocks along a Hilbert curve. A block's zone map has each dimension's least
and greatest value and the labels inside; by interval arithmetic it bounds every score that an anchor
can reach in the block, and so tells which blocks can hold anything of an anchor's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.vectors import matrix, packed
from cairn.llm.words import tidy
from cairn.session import bounded_batches, materialize, small_side, without

#: Rows of a block, anchors of a chunk, zone maps of a page: a task holds one of each at a time.
BLOCK, CHUNK, PAGE = 2048, 512, 512
#: Bits of a dimension on the curve: quarters of its distribution.
CURVE_BITS = 2
#: A normal distribution's upper quarter begins so many deviations above its mean.
QUARTER = 0.6745

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Windows:
    """How many positives an anchor has and negatives a positive, and between which percentages of its score they lie."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve through a grid of ``2 ** bits`` cells a dimension, as bytes in order (Skilling 2004).

    ``cells`` has a row a point; axes are turned into the curve's digits bit by bit, highest first.
    """
    x = [np.ascontiguousarray(c).astype(np.uint8) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint8(1 << level), np.uint8((1 << level) - 1)
        for axis in x:
            turned = (axis & bit) != 0
            swap = np.where(turned, np.uint8(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            if axis is not x[0]:
                axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    fix = np.zeros(len(cells), np.uint8)
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint8(level)) & np.uint8(1) == 1, np.uint8((1 << level) - 1), np.uint8(0))
    digits = np.stack([((axis ^ fix) >> np.uint8(level)) & np.uint8(1) for level in range(bits - 1, -1, -1) for axis in x], axis=1)
    return [row.tobytes() for row in np.packbits(digits, axis=1)]


def _spread(q: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each dimension; two numbers a dimension reach the driver."""

    def run(batches: Batches) -> Batches:
        n, s, t = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(float)
            n, s, t = n + len(x), s + x.sum(0), t + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(s), pa.array(t)], ["at", "n", "s", "t"])

    sums = q.select("q").mapInArrow(tidy(run), "at long, n long, s double, t double").groupBy("at").agg(F.sum("n"), F.sum("s"), F.sum("t")).orderBy("at").collect()
    n, s, t = (np.array([r[i] for r in sums], float) for i in (1, 2, 3))
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(t / np.maximum(n, 1) - mean**2, 0))


def _along_the_curve(q: DataFrame, dim: int) -> DataFrame:
    """``q`` with ``place``: dimensions that spread most come first, each cut into quarters."""
    mean, deviation = _spread(q, dim)
    order = np.argsort(-deviation, kind="stable")
    cuts = np.stack([mean - QUARTER * deviation, mean, mean + QUARTER * deviation])[:, order]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = matrix(batch.column(3), dim)[:, order]
            cells = (x > cuts[0]).astype(np.uint8) + (x > cuts[1]) + (x > cuts[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary())], [*batch.schema.names, "place"])

    return q.mapInArrow(tidy(run), "vec_id long, label long, anchor boolean, q binary, place binary")


def _narrow(x: np.ndarray) -> bytes:
    """Two bytes a number where all fit."""
    return (x.astype("<i2") if x.size and np.abs(x).max() < 1 << 15 else x.astype("<i4")).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if n and len(data) == 2 * n else "<i4").astype(float)


def blocks_of(q: DataFrame, dim: int) -> DataFrame:
    """Rows of ``q`` as blocks along the curve, written to the shared folder: a row a block, whose zone map can be read without its vectors.

    Rows are dealt by ranges of (place, vec_id), so equal vectors, however many, are spread too. Inside a block rows are in order of vec_id.
    """
    lined = _along_the_curve(q, dim).repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    lined = lined.select(F.spark_partition_id().alias("part"), "vec_id", "label", "anchor", "q")

    def block(part: int, nth: int, rows: pa.Table) -> tuple:
        rows = rows.sort_by("vec_id")
        x = matrix(rows["q"].combine_chunks(), dim)
        labels = rows["label"].to_numpy()
        return ((part << 32) + nth, rows["vec_id"].to_pylist(), labels.tolist(), np.flatnonzero(rows["anchor"].to_numpy()).tolist(), _narrow(x), x.min(0).astype("<i4").tobytes(), x.max(0).astype("<i4").tobytes(), np.unique(labels).tolist())

    def run(batches: Batches) -> Batches:
        held, n, nth, part = [], 0, 0, 0
        names = ["block", "ids", "labels", "anchors", "data", "low", "high", "inside"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        out = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
        for batch in batches:
            part = batch.column(0)[0].as_py() if len(batch) else part
            held.append(batch)
            n += len(batch)
            if n < BLOCK:
                continue
            rows, at = pa.Table.from_batches(held), 0
            while n - at >= BLOCK:
                yield out(block(part, nth, rows.slice(at, BLOCK)))
                at, nth = at + BLOCK, nth + 1
            held, n = rows.slice(at).to_batches(), n - at
        if n:
            yield out(block(part, nth, pa.Table.from_batches(held)))

    return materialize(lined.mapInArrow(tidy(run), "block long, ids array<long>, labels array<long>, anchors array<int>, data binary, low binary, high binary, inside array<long>"), "blocks")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows as exact integers: by floating point where sums stay below 2^53."""
    most = (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("vectors are so long that scores pass 64 bits")


def _best(ok: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` best marked cells of each row; columns are in order of ids, so the earlier one wins a tie."""
    rows, columns = np.nonzero(ok)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < most], columns[nth < most]


def chunks_of(blocks: DataFrame, dim: int, positives: int) -> DataFrame:
    """Anchors in chunks along the curve, with ``floor``: the score of the last of enough positives in the anchor's own block, a first bound for free."""

    def run(batches: Batches) -> Batches:
        context, held, nth = None, [], 0
        names = ["chunk", "ids", "labels", "own", "floor", "data"]
        for batch in batches:
            for r in batch.to_pylist():
                context = r["part"] if context is None else context
                at = np.array(r["anchors"])
                ids, labels = np.array(r["ids"]), np.array(r["labels"])
                x = _wide(r["data"], len(ids) * dim).reshape(-1, dim)
                for a in range(0, len(at), CHUNK):
                    own = at[a : a + CHUNK]
                    scores = _products(x[own], x)
                    ok = (labels[own, None] == labels) & (own[:, None] != np.arange(len(ids)))
                    rows, columns = _best(ok, scores, positives)
                    floor = np.full(len(own), np.iinfo(np.int64).min)
                    last = np.arange(len(rows)) - np.searchsorted(rows, rows) == positives - 1
                    floor[rows[last]] = scores[rows[last], columns[last]]
                    held += zip(ids[own].tolist(), labels[own].tolist(), [r["block"]] * len(own), floor.tolist(), x[own].astype("<i4"), strict=True)
                while len(held) >= CHUNK:
                    yield one(context, nth, held[:CHUNK], names)
                    held, nth = held[CHUNK:], nth + 1
        if held:
            yield one(context, nth, held, names)

    def one(part: int, nth: int, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        ids, labels, own, floor, x = zip(*rows, strict=True)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + nth]), *[pa.array([list(v)], longs) for v in (ids, labels, own, floor)], pa.array([np.stack(x).tobytes()], pa.binary())], names)

    read = blocks.where(F.size("anchors") > 0).select(F.spark_partition_id().alias("part"), "block", "ids", "labels", "anchors", "data")
    return materialize(read.mapInArrow(tidy(run), "chunk long, ids array<long>, labels array<long>, own array<long>, floor array<long>, data binary"), "anchors")


def pages_of(blocks: DataFrame) -> DataFrame:
    """Zone maps, some hundreds to a page."""

    def run(batches: Batches) -> Batches:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                if len(held) == PAGE:
                    yield page(held)
                    held = []
        if held:
            yield page(held)

    def page(rows: list[dict]) -> pa.RecordBatch:
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([[r["block"] for r in rows]], longs), pa.array([[r["inside"] for r in rows]], pa.list_(longs)), *[pa.array([b"".join(r[c] for r in rows)], pa.binary()) for c in ("low", "high")]], ["blocks", "inside", "low", "high"]
        )

    return materialize(blocks.select("block", "inside", "low", "high").mapInArrow(tidy(run), "blocks array<long>, inside array<array<long>>, low binary, high binary"), "zones")


def reach(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (rows) with any vector inside each zone (columns): sums of each dimension's own bounds."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def to_read(chunks: DataFrame, pages: DataFrame, dim: int, chosen: Callable[[dict, np.ndarray, np.ndarray, list], np.ndarray]) -> DataFrame:
    """``(chunk, block, at)``: which anchors of a chunk must see a block, as ``chosen(chunk, least, greatest, labels inside)`` marks them.

    Pages are dealt to as many groups as there are shuffle partitions; a chunk goes to each group once, so it meets all zone maps, a page at a time.
    """
    groups = max(1, min(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.count()))
    dealt = pages.select(F.pmod(F.xxhash64("blocks"), F.lit(groups)).alias("group"), F.col("blocks"), "inside", "low", "high")
    spread = chunks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = spread.join(dealt, "group").drop("group")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["blocks"])
                x = np.frombuffer(r["data"], "<i4").reshape(-1, dim).astype(float)
                low, high = (np.frombuffer(r[c], "<i4").reshape(n, dim).astype(float) for c in ("low", "high"))
                ok = chosen(r, *reach(x, low, high), r["inside"])
                found = [(b, np.flatnonzero(column).tolist()) for b, column in zip(r["blocks"], ok.T, strict=True) if column.any()]
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([at for _, at in found], pa.list_(pa.int32()))], ["chunk", "block", "at"])

    return met.mapInArrow(tidy(run), "chunk long, block long, at array<int>")


def _labels_meet(labels: np.ndarray, inside: list[list[int]], same: bool) -> np.ndarray:
    """Whether blocks (columns) hold an anchor's label, or another one."""
    if same:
        return np.stack([np.isin(labels, x) for x in inside], axis=1)
    return np.stack([np.full(len(labels), True) if len(x) > 1 else labels != x[0] for x in inside], axis=1)


def look(chunks: DataFrame, blocks: DataFrame, pairs: DataFrame, dim: int, most: int, windows: bool) -> DataFrame:
    """``(anchor_id, turn, vec_id, score)``: the ``most`` best rows of each read block that an anchor wants.

    Without ``windows``: others of its label from ``floor`` on, turn 0. With them: rows of other labels inside the window of
    each of its positives, from the window's ``floor`` on. Spark joins blocks and chunks by what ``pairs`` tells to read.
    """
    met = pairs.join(chunks, "chunk").join(blocks.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("data").alias("b_data")), "block").drop("block", "chunk", "own")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.array(r["at"])
                ids, labels = np.array(r["b_ids"]), np.array(r["b_labels"])
                x = np.frombuffer(r["data"], "<i4").reshape(-1, dim)[at].astype(float)
                scores = _products(x, _wide(r["b_data"], len(ids) * dim).reshape(-1, dim))
                own = np.array(r["labels"])[at]
                same = own[:, None] == labels
                anchors, found = np.array(r["ids"])[at], []
                if windows:
                    lows, highs = (np.array(r[c], np.int64).reshape(len(r["ids"]), -1)[at] for c in ("lows", "highs"))
                    for turn in range(lows.shape[1]):
                        ok = ~same & (scores >= lows[:, turn, None]) & (scores <= highs[:, turn, None])
                        found.append((turn, *_best(ok, scores, most)))
                else:
                    ok = same & (anchors[:, None] != ids) & (scores >= np.array(r["floor"])[at][:, None])
                    found.append((0, *_best(ok, scores, most)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v), pa.int64()) for v in ([anchors[i] for _, i, _ in found], [np.full(len(i), t) for t, i, _ in found], [ids[j] for _, _, j in found], [scores[i, j] for _, i, j in found])],
                    ["anchor_id", "turn", "vec_id", "score"],
                )

    met_all = met.mapInArrow(tidy(run), "anchor_id long, turn long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "turn").orderBy(F.desc("score"), "vec_id"))
    return met_all.withColumn("rank", rank).where(F.col("rank") <= most)


def _with_windows(chunks: DataFrame, bounds: DataFrame, positives: int) -> DataFrame:
    """``chunks`` with ``lows`` and ``highs``, a number an anchor and turn, from ``bounds`` (anchor_id, turn, low, high); without a positive a window is empty."""
    at = chunks.select("chunk", F.posexplode("ids").alias("i", "anchor_id"))
    listed = at.join(bounds, "anchor_id").groupBy("chunk").agg(F.collect_list(F.struct((F.col("i") * positives + F.col("turn")).cast("int").alias("k"), "low", "high")).alias("w"))
    slots = F.sequence(F.lit(0), F.size("ids") * positives - 1)
    low = F.map_from_entries(F.transform("w", lambda x: F.struct(x["k"], x["low"])))
    high = F.map_from_entries(F.transform("w", lambda x: F.struct(x["k"], x["high"])))
    filled = lambda m, none: F.transform(slots, lambda k: F.coalesce(F.element_at(m, k.cast("int")), F.lit(none).cast("long")))
    return materialize(chunks.join(listed, "chunk").select("chunk", "ids", "labels", "own", "data", filled(low, 1).alias("lows"), filled(high, 0).alias("highs")), "windows")


def hard_negatives(vectors: DataFrame, every: int = 50, scale: float = 256, rules: Windows | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``vectors`` (vec_id, embedding, label).

    Rows take part that have an id, a label and a vector without null or non-finite components; components become floor(scale * x). Anchors are rows whose
    vec_id is divisible by ``every``, positives an anchor's best other rows of its label, negatives the best rows of other
    labels whose scores lie within the window of a positive's score: low * p <= 100 * n <= high * p, all in
    integers. Ties go to the smaller vec_id. Of rows with the same vec_id the least in order of (vector, label) takes part. Shorter
    vectors end in zeros. An empty table, or one without anchors, gives no rows; other columns aren't read. Scores beyond 64 bits are an error.

    Lossless: a block isn't read only if its bounds show that it holds nothing of an anchor's windows that could still be among the
    first. First bounds come from the anchor's own block. Where dimensions are many and vectors fill all directions, bounds are wide and most blocks are read.
    """
    rules = rules or Windows()
    spark = vectors.sparkSession
    bounded_batches(spark)
    given = vectors.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % every == 0).alias("anchor"), "embedding")
    q = materialize(packed(given, "embedding", scale), "packed")
    often = materialize(q.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated")
    if not often.isEmpty():
        one = q.join(small_side(often, 16), "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("q", "label", "anchor", "dim")).alias("r"))
        q = materialize(without(q, often, "vec_id").unionByName(one.select("vec_id", "r.label", "r.anchor", "r.q", "r.dim")), "packed")
    dim = max(1, q.agg(F.max("dim")).first()[0] or 0)
    blocks = blocks_of(q.drop("dim"), dim)
    chunks, pages = chunks_of(blocks, dim, rules.positives), pages_of(blocks)

    def near(chunk: dict, least: np.ndarray, greatest: np.ndarray, inside: list) -> np.ndarray:
        return (greatest >= np.array(chunk["floor"])[:, None]) & _labels_meet(np.array(chunk["labels"]), inside, True)

    best = look(chunks, blocks, to_read(chunks, pages, dim, near), dim, rules.positives, False)
    best = materialize(best.select("anchor_id", (F.col("rank") - 1).cast("long").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    share = lambda p: F.expr(f"(positive_score * {p} - pmod(positive_score * {p}, 100)) div 100")  # noqa: E731  rounded down, in integers
    bounds = best.select("anchor_id", "turn", (-share(-rules.low)).alias("low"), share(rules.high).alias("high"))
    wide = _with_windows(chunks, bounds, rules.positives)
    own = chunks.select("chunk", F.posexplode("own").alias("i", "block")).groupBy("chunk", "block").agg(F.collect_list("i").alias("at"))
    first = look(wide, blocks, own, dim, rules.negatives, True).where(F.col("rank") == rules.negatives)
    raised = bounds.join(first.select("anchor_id", "turn", "score"), ["anchor_id", "turn"], "left").select("anchor_id", "turn", F.greatest("low", F.coalesce("score", "low")).alias("low"), "high")
    close = _with_windows(chunks, raised, rules.positives)

    def inside_window(chunk: dict, least: np.ndarray, greatest: np.ndarray, inside: list) -> np.ndarray:
        lows, highs = (np.array(chunk[c], np.int64).reshape(len(chunk["ids"]), -1) for c in ("lows", "highs"))
        ok = np.zeros(least.shape, bool)
        for low, high in zip(lows.T[:, :, None], highs.T[:, :, None], strict=True):
            ok |= (low <= high) & (greatest >= low) & (least <= high)
        return ok & _labels_meet(np.array(chunk["labels"]), inside, False)

    found = look(close, blocks, to_read(close, pages, dim, inside_window), dim, rules.negatives, True)
    named = found.select("anchor_id", "turn", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(best, ["anchor_id", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
