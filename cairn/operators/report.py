"""The whole search for duplicates: exact copies, near ones, then items that hold most of another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import groups, hamming, partial
from cairn.operators.components import connected_components, joined_components
from cairn.session import counted_side, materialize


@dataclass
class Report:
    """``members`` and ``groups`` of duplicates, and ``crops``, the pairs of which one holds most of the other."""

    members: DataFrame
    groups: DataFrame
    crops: DataFrame


def exact_links(items: DataFrame) -> DataFrame:
    """``(a, b)``: each further item of a digest with the smallest of it; a null digest isn't read, an empty one says nothing."""
    first = items.where("digest <> ''").groupBy("digest").agg(F.min("item_id").alias("a"))
    return items.join(counted_side(materialize(first, "digests"), 128), "digest").where("item_id <> a").select("a", F.col("item_id").alias("b"))


def near_links(items: DataFrame, level: str) -> DataFrame:
    """``(a, b)``: pairs of class representatives with near signatures, and each member of a class with its representative. Flat items have none."""
    classes = hamming.signature_classes(items).where("item_id <> class_id")
    return hamming.hamming_pairs(items, level).unionByName(classes.select(F.col("class_id").alias("a"), F.col("item_id").alias("b")))


def find_duplicates(items: DataFrame, described: DataFrame, level: str = "close", width: int = 1) -> Report:
    """Groups of duplicates among ``items``, by all evidence there is.

    ``items`` has item_id, path, size, mtime, digest, phash, dhash, width, height and flat; ``described`` item_id, pos and d0..d3, for items that
    have descriptors. Links by equal digests and by near signatures come first. Candidates for parts of another are then cut to the best six of
    either end, and of these only pairs in different components are matched, the smaller picture in the larger; what they join is
    merged into the components as they are. Flat items join by digest and by descriptors only. An item of equal digest
    is matched through the smallest one of its digest, to which it is linked already.
    """
    links = exact_links(items).unionByName(near_links(items, level))
    labels = materialize(connected_components(materialize(links, "links")), "labels")
    known = partial.dealt(materialize(described.join(exact_links(items).select(F.col("b").alias("item_id")), "item_id", "left_anti"), "described"))
    chosen = partial.across_components(materialize(partial.best_candidates(known), "best"), labels)
    sizes = items.select("item_id", (F.col("width") * F.col("height")).cast("long").alias("length"))
    crops = materialize(partial.containment_pairs(known, chosen, sizes, level, width), "crops")
    labels = materialize(joined_components(labels, crops), "joined")
    found = groups.members(items, None, crops, labels)
    return Report(found, groups.summaries(found), crops)
