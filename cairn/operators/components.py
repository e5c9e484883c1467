"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import session
from cairn.session import materialize


def _low(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes``, at most ``most`` of them, to be joined: where they may be many they don't go through the driver, however few bytes Spark takes them for."""
    return nodes.hint("merge") if most * 64 > session.SENT_BYTES else nodes


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_low(low, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(_low(low, n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is two joins on
    a node, whose hot keys AQE can split; the edge table is written to the shared folder after each
    round. Ends when a round leaves the edges as they were: then every edge points at its
    component's smallest node. Edges with a null end are ignored; a loop (a = b) yields its node alone.
    """
    given = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = given.where("x = y").select(F.col("x").alias("node"))
    e = given.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    print_of = (F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
    e, seen = materialize(e, "edges"), None
    while True:
        now = tuple(e.agg(*print_of).first())
        if now == seen or not now[0]:
            break
        seen, e = now, materialize(_small_star(_large_star(e, now[0]), now[0]), "edges")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).union(loops.join(_low(e.select(F.col("u").alias("node")), now[0]), "node", "left_anti")).distinct()
    return found.union(roots.select("node", F.col("node").alias("component")))


def joined_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (node, component) after more ``edges``: components that these join become one, named by its smallest node.

    Only the new edges are run over, from component to component; earlier edges aren't looked at again. A node that had no label
    was a component of its own; it has one now if an edge names it.
    """
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("component").alias(name))
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    lifted = ends.join(of("x", "cx"), "x", "left").join(of("y", "cy"), "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b")).distinct()
    moved = materialize(connected_components(lifted), "moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionByName(moved.join(labels.select("node"), "node", "left_anti"))
