"""Connected components by label contraction over landed edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import land


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): the smallest node that is reachable.

    Alternates two steps until all edges lead from a node to its root: every node hands its
    smallest neighbour to its larger neighbours, then to its smaller ones. Each step is an
    aggregate with map-side combine and a join, so a node with very many edges is never
    gathered. Repeated edges, loops and rows with nulls are harmless; an empty table gives no
    rows.
    """
    edges = land(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = land(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = land(small.select("e.a", "e.b").where("a > b").distinct())
    return _ends(edges)


def _stars(edges: DataFrame) -> bool:
    """Does every node have one parent, and no parent a parent of its own?"""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    odd = edges.select(ends.alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return odd.where("up > 1 or up = 1 and down = 1").isEmpty()


def _ends(stars: DataFrame) -> DataFrame:
    pairs = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
