"""Exact copies: groups by content digest, the one to keep, and what the rest take up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranks import running


def with_shared_size(files: DataFrame) -> DataFrame:
    """Files whose size another file has: only these need a digest. A semi join, so no group is gathered."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).drop(content)


def exact_members(files: DataFrame) -> DataFrame:
    """``(digest, rank, path, size, mtime, keep)`` of files with equal content; rank 1 is kept.

    Only sizes that occur twice are digested. Null content is unreadable: in no group. However many copies a content has, no task ranks them all.
    """
    signed = digests(with_shared_size(files).select("path", "size", "mtime", "content")).where("digest is not null")
    shared = signed.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
    ranked = running(signed.join(shared, "digest", "left_semi"), ["digest"], [-F.col("size"), "mtime", F.char_length("path"), "path"])
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("keep", F.col("rank") == 1)


def exact_groups(files: DataFrame) -> DataFrame:
    """``(keeper, copies, reclaimable)`` by group: the keeper by aggregation, so that a hot digest isn't sorted."""
    signed = digests(with_shared_size(files).select("path", "size", "mtime", "content")).where("digest is not null")
    best = F.struct((-F.col("size")).alias("s"), F.col("mtime"), F.char_length("path").alias("l"), F.col("path"))
    groups = signed.groupBy("digest").agg(F.min(best).alias("k"), F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")).where("copies > 1")
    return groups.select(F.col("k.path").alias("keeper"), "copies", (F.col("bytes") + F.col("k.s")).alias("reclaimable"))


def unreadable(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content can't be read (null), whose features may still be known: listed apart, in no group."""
    return files.where(F.col(content).isNull()).drop(content)


def totals(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: files scanned, those that can't be read, and ``report``'s columns."""
    counts = files.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col(content).isNull()).alias("unreadable"))
    return counts.join(F.broadcast(report(exact_groups(files))))  # two single rows


def report(groups: DataFrame) -> DataFrame:
    """One row: groups, copies beyond the kept ones, their bytes."""
    none = F.lit(0)
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("copies") - 1), none).alias("extra_copies"), F.coalesce(F.sum("reclaimable"), none).alias("reclaimable"))


def group_page(groups: DataFrame, page: int, size: int = 30) -> DataFrame:
    """A page of the groups, most reclaimable first."""
    return groups.orderBy(F.desc("reclaimable"), "keeper").offset(page * size).limit(size)
