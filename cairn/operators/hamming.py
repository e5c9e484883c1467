"""Pairs of near-equal 64-bit signatures, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import counted_side, materialize

#: Limits by level: of the frequency signature, of the gradient signature. And the ratio that aspects stay under.
LEVELS = {"close": (8, 14), "loose": (14, 20)}
ASPECT = 1.08
#: Signatures of a block, comparisons held at once, and tasks at most for all pairs of blocks.
BLOCK, AT_ONCE, TASKS = 8192, 1 << 18, 4096


def signature_classes(items: DataFrame) -> DataFrame:
    """``(item_id, class_id)``: items of equal signatures and size, named by the smallest of them; flat ones have none."""
    same = ["phash", "dhash", "width", "height"]
    first = items.where("not flat").groupBy(*same).agg(F.min("item_id").alias("class_id"))
    return items.where("not flat").join(counted_side(materialize(first, "classes"), 128), same).select("item_id", "class_id")


def _tiles(placed: DataFrame) -> tuple[DataFrame, int]:
    """``placed`` (item_id, shape, ...) once for each tile (shape, i, step, j) that needs it, as its ``left`` side or not, and how many tiles there are.

    A tile is a pair of blocks, i of a shape and j of the same shape (step 0) or the next one (step 1). A shape has as many blocks as its rows fill.
    """
    sizes = materialize(placed.groupBy("shape").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "shapes")  # some hundred shapes at most
    beside = lambda by, name: sizes.select((F.col("shape") - by).alias("shape"), F.col("blocks").alias(name))
    known = sizes.join(beside(1, "next"), "shape", "left").join(beside(-1, "last"), "shape", "left")
    met = placed.join(F.broadcast(known), "shape").withColumn("own", F.pmod(F.xxhash64("item_id"), "blocks").cast("int"))

    def among(n: Column, tile: Callable[[Column], list[Column]]) -> Column:
        """A tile for each block below ``n``; none where it is null."""
        named = lambda k: F.struct(*[c.cast("int").alias(x) for c, x in zip(tile(k), ["shape", "i", "step", "j", "left"], strict=True)])
        return F.transform(F.slice(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), 1, F.coalesce(n, F.lit(0))), named)

    shape, own, yes, no = F.col("shape"), F.col("own"), F.lit(1), F.lit(0)
    tiles = F.concat(
        among(F.col("blocks") - own, lambda k: [shape, own, no, own + k, yes]), among(own, lambda k: [shape, k, no, own, no]),
        among(F.col("next"), lambda k: [shape, own, yes, k, yes]), among(F.col("last"), lambda k: [shape - 1, k, yes, own, no]),
    )
    n = known.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2 + F.col("blocks") * F.coalesce("next", F.lit(0)))).first()[0]
    return met.select("item_id", "phash", "dhash", "ratio", F.explode(tiles).alias("t")).select("item_id", "phash", "dhash", "ratio", "t.*"), int(n or 1)


def _compared(level: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Near pairs (x, y) of a tile's rows: of each left one with each right one, or of all where there is one block only."""
    p_limit, d_limit = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        left = rows["left"].to_numpy() == 1
        lone = rows["i"][0] == rows["j"][0] and rows["step"][0].as_py() == 0
        ids = rows["item_id"].combine_chunks()
        p, d = (rows[c].to_numpy().view(np.uint64) for c in ("phash", "dhash"))
        ratio, ours = rows["ratio"].to_numpy(), np.flatnonzero(left)
        theirs = ours if lone else np.flatnonzero(~left)
        step = max(1, AT_ONCE // max(1, len(theirs)))
        for at in range(0, len(ours), step):
            x, y = np.nonzero(np.bitwise_count(p[ours[at : at + step], None] ^ p[theirs]) <= p_limit)
            x += at
            if lone:
                x, y = x[y > x], y[y > x]
            x, y = ours[x], theirs[y]
            near = (np.bitwise_count(d[x] ^ d[y]) <= d_limit) & (np.maximum(ratio[x], ratio[y]) / np.maximum(np.minimum(ratio[x], ratio[y]), 1e-6) < ASPECT)
            if near.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[near])), ids.take(pa.array(y[near]))], ["x", "y"])

    return run


def hamming_pairs(items: DataFrame, level: str = "close") -> DataFrame:
    """``(a, b)``, a < b, of class representatives whose signatures lie within ``level``'s limits.

    ``items`` has item_id, phash, dhash, width, height, flat. Rows of like aspect are cut into blocks, and each pair of blocks is a group of
    two blocks' rows in some task, compared by bit counts (as the reference compares them). Multi-index hashing at these limits lets
    one pair of sixteen meet, each as a joined row of its own, which costs more than to compare them all. Nothing is broadcast but the
    number of blocks by aspect; a task holds two blocks. Work grows with the square of the rows of an aspect, copies of a row
    with the blocks. Lossless; copies are in ``signature_classes`` instead of pairs.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    same = ["phash", "dhash", "width", "height"]
    reps = items.where("not flat").dropna(subset=same).groupBy(*same).agg(F.min("item_id").alias("item_id"))
    ratio = F.when(F.col("height") == 0, F.lit(0.0)).otherwise(F.col("width") / F.col("height"))
    # shapes are a little wider than the ratio, so that two within it are in the same or the next one however logarithms are rounded
    shape = F.floor(F.log(F.greatest(ratio, F.lit(1e-6))) / (log(ASPECT) * 1.001)).cast("int")
    placed = materialize(reps.select("item_id", "phash", "dhash", ratio.alias("ratio"), shape.alias("shape")), "shaped")
    dealt, n = _tiles(placed)
    # a tile's work isn't told by its bytes, so partitions mustn't be merged by these
    tiles = dealt.repartition(min(n, TASKS), "shape", "i", "step", "j").groupBy("shape", "i", "step", "j")
    met = tiles.applyInArrow(_compared(level), f"x {kind}, y {kind}").where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
