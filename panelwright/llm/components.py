"""Connected components of an edge table, by alternating star contractions on DataFrames.

Each round rewires every node to the smallest node it knows of; edges never grow in number and the graph
ends as stars around each component's smallest node. Neighbour lists are never gathered: a node's minimum
is a pre-aggregated sum-like value joined back to its edges, so a hub of any degree stays spread out
(adaptive execution splits its join partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, apart


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): every v and u itself point to the smallest of u's neighbours and u."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(apart(edges, "u").alias("w"), F.least("u", "least").alias("m"))
    return edges.join(least.hint("merge"), edges["u"] == least["w"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct ``edges`` (u, v), u > v, has one edge and no v is a u too; then v is the least of all that reach it."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = edges.select(F.explode(ends).alias("end")).select("end.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by_node.agg(F.max((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()[0]


def pointers(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) that is not its component's smallest, with the smallest node reachable from it.

    Self loops and repeated edges are harmless; an empty edge table gives an empty result. Each round's table is written
    to the shared folder and read again, as a checkpoint would hand on its plan's constraints, whose number grows with the
    rounds; a table is removed once the next is written, and the last stays, as the result reads it. The rounds end as soon
    as all that is left are stars, so no round is spent on seeing that nothing changes.
    """
    written = Written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        now = written.df
        # u > v throughout. Large star: larger neighbours of u go to the least of its whole neighbourhood; as many rows as edges, so repeated ones may stay.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its smaller neighbours go to the least of them.
        star = _star(large)
        small = star.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, written = written, Written(small, "edges")
        before.remove()
        now = written.df
        if _stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node reachable from it (``pointers`` and the smallest nodes)."""
    found = pointers(edges)
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
