"""Connected components of an edge table, by alternating large and small stars.

Only minima by node and joins with them are used, so the many neighbours of a
hub are combined before they are shuffled; no node's neighbours are gathered.
Each edge goes from a larger node to a smaller one. The large star moves its
end to the end's own smallest neighbour, found in a table of its own, so that
the join is a plain one and is split at a hub. Each round is written to the
shared folder, and the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; read it while scratch lasts.

    edges: (a, b) of whole numbers without nulls, in any order; repeats and
    edges from a node to itself don't matter; no edges, no rows.
    """
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        before = now
        least = scratch(_least(now), "least")
        large = now.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        own = _least(large)
        small = large.join(own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch(small.unionByName(own.select("a", F.col("m").alias("b"))).distinct(), "stars")
        scratch.drop(least)
        scratch.drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether the different edges from a larger a to a smaller b are stars already: each node is either a centre, or has one edge down.

    Costs one aggregate, where a round that changes nothing would cost six.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("end")
    nodes = edges.select(ends).select("end.*").groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.agg(F.bool_or((F.col("down") > 1) | (F.col("down") > F.col("least")))).first()[0] is not True
