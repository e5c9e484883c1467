"""What jobs need from the session: a shared scratch folder, and joins that look at sizes first."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many bytes, by the row count times a stated row width.
BROADCAST_BYTES = 64 << 20
#: The same for sides that grow with links or groups, of which a query may hold several in its driver.
SENT_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset on a local master (a single machine, tests) a temporary folder becomes the
    setting; on a cluster, whose executors couldn't see that folder, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` for what runs from now on, unless the session has a setting of its own.

    Texts are large rows: at Spark's default of 64 MB an executor would hold several such batches for each Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "67108864", "64MB"):
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, object] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit / row_bytes`` rows, else unchanged.

    The check counts rows up to the limit only; a larger side is joined by a shuffle.
    """
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def counted_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to be joined: broadcast if it was counted to be within ``SENT_BYTES``, else by a sorted join.

    Left alone, Spark broadcasts what has under ``autoBroadcastJoinThreshold`` in its files, or in a shuffle, on either side of the join;
    in the driver's memory that is many times as much.
    """
    side = small_side(df, row_bytes, SENT_BYTES)
    return df.hint("merge") if side is df else side


def without(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is among ``found``'s, whatever other columns either has. Null keys stay."""
    gone = materialize(found.select(F.col(key).alias("key")).where("key is not null").distinct(), "gone")
    gone = small_side(gone, 16)
    return df.join(gone, df[key] == gone["key"], "left_anti")


def join_counted(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, row_bytes: int = 64) -> DataFrame:
    """``rows`` left-joined with ``found``, a row a key whose column ``n`` tells how many of the ``total`` rows have it.

    Keys of over a hundred-thousandth of all rows are at most 100,000 and are broadcast, so that no
    task gets a hot key's rows; the others join by a shuffle.
    """
    least = max(500, total // 100_000)
    hot = small_side(materialize(found.where(F.col(n) > least).withColumn("_hot", F.lit(True)), "hot-keys"), row_bytes)
    tried = rows.join(hot, key, "left")
    columns = [*rows.columns, *[c for c in found.columns if c not in rows.columns]]
    cold = tried.where("_hot is null").select(*rows.columns).join(found.where(F.col(n) <= least), key, "left")
    return tried.where("_hot").select(columns).unionByName(cold.select(columns))
