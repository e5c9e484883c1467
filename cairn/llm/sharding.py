"""Shards of bounded bytes by extendible hashing.

A row's key is hashed to 60 bits. A bucket is a prefix of those bits; one that holds more bytes
than a shard may have splits on the next bit, others stay. The directory maps every key to the one
unsplit prefix of its hash.

Bytes are summed once, by prefix at a depth that suits the total. Sums of shorter prefixes follow
from these cells, so all splits down to that depth are decided at once; cells still too large are
looked at deeper, and only those. Rows of one key share all bits: what a single key has beyond a
shard goes to overflow shards, dealt by running byte sums that are formed per partition first.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import join_counted, materialize, small_side

BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as BIGINT; a null key has a hash of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hashed: str, depth: int) -> Column:
    return F.shiftright(F.col(hashed), BITS - depth) if depth else F.lit(0).cast("long")


def _split(cells: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """For each prefix of ``high`` bits the depth from ``low`` on of the first prefix that fits, or null."""
    depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    up = cells.select("cell", "bytes", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"))
    fits = up.join(sums.where(F.col("total") <= max_bytes), ["depth", "prefix"])
    found = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def directory(hashed: DataFrame, max_bytes: int) -> DataFrame:
    """``(depth, prefix, overfull)`` of the unsplit buckets of ``hashed`` (columns ``h`` and ``bytes``).

    overfull marks single hashes that are larger than a shard.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    high = min(BITS, max(1, ceil(log2(max(1, total / max_bytes))) + 3))
    low, rest, done = 0, hashed, None
    while True:
        cells = materialize(rest.groupBy(_prefix("h", high).alias("cell")).agg(F.sum("bytes").alias("bytes")), "shard-cells")
        depth = materialize(_split(cells, low, high, max_bytes), "shard-depths")
        end = high == BITS
        fit = depth.where(F.lit(True) if end else F.col("depth").isNotNull())
        closed = fit.select(F.coalesce("depth", F.lit(high)).alias("depth"), "cell", F.col("depth").isNull().alias("overfull"))
        closed = closed.select("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"), "overfull").distinct()
        done = closed if done is None else done.unionByName(closed)
        still = depth.where("depth is null").select("cell")
        if end or not still.take(1):
            return done
        rest = rest.withColumn("cell", _prefix("h", high)).join(still, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + 8)


#: Size classes of rows, by shares of a shard: rows up to the first share, and the bytes between two
#: shards' beginnings. A shard's last row begins before that and so ends within the limit.
CLASSES = ((1 / 8, 7 / 8), (1 / 2, 1 / 2))


def _overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Numbers the shards of overfull hashes, each within the limit unless a single row is beyond it.

    Rows of a size class follow each other; a row's shard is the place of its first byte over the
    class's width. Rows of over half a shard stand alone. Places are running sums within a
    partition, after the sums of the partitions before it, so no task sees a whole key. Shards but
    the last of a class are filled to three eighths at least, those of small rows to three quarters.
    """
    size = F.col("bytes")
    nth = reduce(lambda rest, k: F.when(size <= int(CLASSES[k][0] * max_bytes), k).otherwise(rest), reversed(range(len(CLASSES))), F.lit(len(CLASSES)))
    alone = F.col("class") == len(CLASSES)
    width = reduce(lambda rest, k: F.when(F.col("class") == k, max(1, int(CLASSES[k][1] * max_bytes))).otherwise(rest), range(len(CLASSES)), F.lit(1))
    rows = rows.withColumn("class", nth).withColumn("place", F.when(alone, F.lit(1).cast("long")).otherwise(size)).withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "shard-overfull")
    parts = rows.groupBy("h", "class", "part").agg(F.sum("place").alias("b"))
    before = parts.withColumn("before", F.coalesce(F.sum("b").over(Window.partitionBy("h", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("place").over(Window.partitionBy("h", "class", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before.drop("b"), ["h", "class", "part"])
    turn = F.floor((F.col("before") + F.col("inside")) / width).cast("long")
    return placed.withColumn("overflow", turn * (len(CLASSES) + 1) + F.col("class"))


def _placed(hashed: DataFrame, found: DataFrame) -> DataFrame:
    """``hashed`` with its bucket's depth, prefix and overfull: every row is joined once.

    Only cells, the prefixes of the deepest depth in use, ask for a bucket at each depth; rows then join their cell, hot ones by
    broadcast. An overfull hash stands for its cell, as the buckets beside it are no deeper.
    """
    deepest = found.where("not overfull").agg(F.max("depth")).first()[0] or 0
    short = F.expr(f"shiftright(prefix, {BITS} - {deepest})")
    n_over, n_cells = found.where("overfull").agg(F.count(F.lit(1)), F.count_distinct(short)).first()
    if n_over > n_cells:  # two of them would share a cell
        deepest = BITS
    tries_at = F.when(F.col("overfull"), F.lit(deepest)).otherwise(F.col("depth"))
    asked = found.select("depth", "prefix", "overfull", tries_at.alias("try"), F.when(F.col("overfull"), F.expr(f"shiftright(prefix, {BITS} - {deepest})")).otherwise(F.col("prefix")).alias("try_prefix"))
    depths = [r[0] for r in asked.select("try").distinct().orderBy("try").collect()]  # at most 61
    cell = _prefix("h", deepest)
    cells = hashed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    up = F.explode(F.array(*[F.struct(F.lit(d).alias("try"), F.expr(f"shiftright(cell, {deepest - d})").alias("try_prefix")) for d in depths]))
    at = cells.select("cell", "n", up.alias("at")).select("cell", "n", "at.*").join(small_side(asked, 48), ["try", "try_prefix"]).drop("try", "try_prefix")
    at = materialize(at, "shard-cells-placed")
    total = at.agg(F.sum("n")).first()[0] or 0
    return join_counted(hashed.withColumn("cell", cell), at, "cell", "n", total).drop("cell", "n")


def assign_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``(key, bytes, depth, prefix, overflow, shard)`` per row of ``docs``.

    bytes is the text's size in UTF-8 (null: 0). shard names the bucket: the prefix's bits, and a
    number for what a single key has beyond one shard. Every shard holds at most ``max_bytes``,
    except that a row larger than that stands alone, as rows are never cut. Null keys are hashed together as one key of their own; repeated rows are rows; an empty
    table has no shards; other columns are ignored, or with ``carry`` kept in the struct ``row``.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rest = ["row"] * carry
    hashed = docs.select(F.col(key).alias("key"), size.alias("bytes"), hash_bits(F.col(key)).alias("h"), *[F.struct("*").alias(r) for r in rest])
    found = materialize(directory(hashed.select("h", "bytes"), max_bytes), "shard-directory")
    if found.isEmpty():
        return hashed.select("key", "bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("overflow"), *rest, F.lit("").alias("shard"))
    placed = _placed(hashed, found)
    whole = placed.where("not overfull").withColumn("overflow", F.lit(0).cast("long"))
    columns = ["key", "bytes", "depth", "prefix", "overflow", *rest]
    if found.where("overfull").take(1):
        whole = whole.select(columns).unionByName(_overflow(placed.where("overfull"), max_bytes).select(columns))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    shard = F.concat(bits, F.when(F.col("overflow") > 0, F.concat(F.lit("+"), F.col("overflow").cast("string"))).otherwise(""))
    return whole.select(*columns, shard.alias("shard"))


def write_shards(docs: DataFrame, path: str, max_bytes: int, key: str = "doc_id", text: str = "text") -> None:
    """``docs`` as Parquet below ``path``, a folder to a shard, named ``b`` and its bits (of column ``shard``, or ``_shard`` where ``docs`` has a column of that name). Every row is written once, whatever its key."""
    placed = assign_shards(docs, max_bytes, key, text, carry=True).select(F.col("row"), F.concat(F.lit("b"), "shard").alias("_shard"))
    folder = "shard" if "shard" not in docs.columns else "_shard"
    placed.select("row.*", F.col("_shard").alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


def oracle(max_bytes: int, deepest: int = 40) -> str:
    """DuckDB SQL for ``assign_shards`` over documents whose keys differ, by the definition."""
    return f"""
with rows as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
                     ('0x' || substr(md5(coalesce(doc_id::varchar, chr(0) || 'null')), 1, 15))::bigint as h from documents),
     tries as (select doc_id, bytes, h, d::int as depth, h >> (60 - d)::int as prefix from rows, range(0, {deepest + 1}) r(d)),
     sums as (select depth, prefix, sum(bytes) as total from tries group by all),
     first as (select doc_id, min(depth) as depth from tries join sums using (depth, prefix) where total <= {max_bytes} group by all),
     placed as (select doc_id, bytes, depth, prefix from tries join first using (doc_id, depth)),
     named as (select *, case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end as shard from placed)
select doc_id, bytes, depth, shard from named"""
