"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _common as C


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  node, component: the smallest node that it is linked with.

    In each round every node takes the neighbour of the least rank (or itself) as
    parent, and the edges are drawn between parents.  Ranks are the labels in one
    round, which ends stars around their smallest node at once, and new random numbers
    in the next, which leaves a share of the nodes whatever their labels, so rounds grow
    with the logarithm of a chain.  They end when no edge is left; the parents are
    then followed back, and each component takes its smallest node's name.  All
    tables are in the shared folder.
    """
    edges = C.stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = len(parents)
        ranked = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 else F.col(c)).alias("r"), F.col(c).alias("n"))  # noqa: B023,E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("m"))
        parent = C.stored(best.select("node", F.least("m", ranked("node"))["n"].alias("parent")), "parents")
        parents.append(parent)
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        new = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        edges = C.stored(new.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = parents[-1].toDF("node", "component")
    for parent in reversed(parents[:-1]):
        upper = out.toDF("parent", "component")
        out = parent.join(upper, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    out = C.stored(out, "components")
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return C.spread_join(out, least, "component", "node").select("node", F.col("least").alias("component"))
