"""Ranks, running sums and free numbers within keys of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize


def running(df: DataFrame, keys: list[str], order: list[Column | str], value: Column | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: how many rows of the same ``keys`` there are up to this one in ``order``, or the sum of ``value`` over them.

    Rows are dealt out by ranges of keys and order together, so a key's rows lie in as many ranges as it takes; each range is summed
    first, and only what stands before it is added inside. No task holds more than a range. Null keys are a key; ``order`` should tell
    rows of a key apart, equal rows are ranked in any order. A null value counts as nothing.
    """
    own = df.withColumn("_value", F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0)))
    columns = {f"_o{i}": o if isinstance(o, Column) else F.col(o) for i, o in enumerate(order)}
    by = [*keys, *columns]
    ranged = own.withColumns(columns).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    whole = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    # a range goes on with one key at most, so there are no more of these than ranges
    before = sums.withColumn("_before", F.sum("_sum").over(whole)).where("_before is not null")
    before = F.broadcast(before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_inside", F.sum("_value").over(inside)).join(before, same, "left")
    return out.select(*df.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))


def free_numbers(claims: DataFrame, taken: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``claims`` with ``name``: within ``keys``, in ``order``, each gets the least number from 1 on that isn't ``taken`` (keys, number) and no earlier one has.

    The k-th taken number t leaves t - k free ones below it, so the n-th claim's number is n and one more for each taken number with t - k < n:
    a running count over claims and taken numbers in one order. Nothing is gathered, neither a key's claims nor its numbers.
    """
    known = materialize(taken.where("number >= 1").select(*keys, F.col("number").cast("long").alias("number")).distinct(), "taken")
    if known.isEmpty():
        return running(claims, keys, order, name=name)
    ranked = running(claims, keys, order, name="_n")
    gaps = running(known, keys, ["number"], name="_k").select(*keys, (F.col("number") - F.col("_k")).alias("_n"), F.lit(1).cast("long").alias("_gap"))
    line = ranked.withColumn("_gap", F.lit(0).cast("long")).unionByName(gaps, allowMissingColumns=True)
    passed = running(line, keys, ["_n", "_gap"], F.col("_gap"), "_passed")  # a claim comes before gaps that leave as many as it needs
    return passed.where("_gap = 0").select(*claims.columns, (F.col("_n") + F.col("_passed")).alias(name))
