"""Marking members of groups, by set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suggested(members: DataFrame) -> DataFrame:
    """All but the keepers."""
    return members.where("rank > 1").select("path")


def toggle(marks: DataFrame, paths: DataFrame) -> DataFrame:
    """Marks with ``paths`` switched: symmetric difference."""
    return marks.exceptAll(paths).union(paths.exceptAll(marks))


def keep_only(members: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """All of the group of ``path`` marked except itself."""
    group = members.where(F.col("path") == path).select("group_id")
    own = members.join(group, "group_id", "left_semi").select("path")
    return marks.join(own, "path", "left_anti").union(own.where(F.col("path") != path))


def keep_group(members: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """No member of the group of ``path`` marked."""
    group = members.where(F.col("path") == path).select("group_id")
    return marks.join(members.join(group, "group_id", "left_semi").select("path"), "path", "left_anti")


def exclusions(old: DataFrame, shown: DataFrame, unticked: DataFrame) -> DataFrame:
    """What stays excluded: old exclusions that aren't shown, and what is unticked now."""
    return old.join(shown, "path", "left_anti").select("path").union(unticked.select("path")).distinct()


def _flagged(members: DataFrame, marks: DataFrame) -> DataFrame:
    return members.join(marks.select("path").distinct().withColumn("_m", F.lit(True)), "path", "left").withColumn("marked", F.col("_m").isNotNull()).drop("_m")


def fully_marked(members: DataFrame, marks: DataFrame) -> DataFrame:
    """Groups of which every member is marked: nothing would be left."""
    return _flagged(members, marks).groupBy("group_id").agg(F.bool_and("marked").alias("every"), F.count(F.lit(1)).alias("members")).where("every").select("group_id", "members")


def marked_totals(members: DataFrame, marks: DataFrame) -> DataFrame:
    found = members.join(marks.select("path").distinct(), "path", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def after_removal(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Members that are left in groups that still have two."""
    left = members.join(removed.select("path").distinct(), "path", "left_anti")
    groups = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("group_id")
    return left.join(groups, "group_id", "left_semi")


def common_parent(paths: DataFrame, *by: str) -> DataFrame:
    """The longest folder that all of ``path`` lie below, of each group ``by``: what the first and the last in order share."""
    ends = paths.select(*by, F.split(F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1), "/").alias("p")).groupBy(*by).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    shared = F.aggregate(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get("a", i) == F.get("b", i)), n + 1).otherwise(n))
    return ends.select(*by, F.array_join(F.slice("a", F.lit(1), shared), "/").alias("folder"))


def quarantine(members: DataFrame, marks: DataFrame, dest: str) -> DataFrame:
    """Marked members that aren't below ``dest`` yet, as plan rows to be checked before they move."""
    chosen = members.join(marks.select("path").distinct(), "path", "left_semi").where(~F.startswith("path", F.lit(dest + "/")))
    return chosen.select("path", "size", F.lit("photos").alias("category"), F.lit(dest).alias("dest_folder"), F.substring_index("path", "/", -1).alias("dest_name"), F.lit("check_first").alias("status"), F.lit(True).alias("included"))
