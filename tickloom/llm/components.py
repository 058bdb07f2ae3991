"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

#: Rounds whose maps are composed in one plan.
COMPOSED = 4


def composed(one: DataFrame, two: DataFrame) -> DataFrame:
    """(node, to): where two leads from where one leads, or there where two doesn't lead on."""
    two = two.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return one.join(two, "to", "left").select("node", F.coalesce("next", "to").alias("to"))


def contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(node, to) of one round, and the links (a, b) left between the nodes led to.

    Every node points to that of its neighbours and itself which has the lowest rank, a hash drawn anew each round, and
    then four pointers are followed. Of a chain's nodes about a third are led to, in whatever order their ids stand.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), c.alias("node"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low"))
    to = to.select(F.col("a").alias("node"), F.least("low", rank(F.col("a")))["node"].alias("to"))
    to = composed(to, to)
    to = written(composed(to, to), "pointers")
    left = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
    left = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
    return to, written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")


def connected(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of links (columns a and b of one type).

    The rounds follow the logarithm of the longest chain. Every round is a written table, and so is the map from all
    nodes to those left after every few rounds, so no plan grows with them.
    """
    edges = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found, turn = None, 0
    while not edges.isEmpty():
        step, edges = contract(edges, turn)
        found, turn = step if found is None else composed(found, step), turn + 1
        if turn % COMPOSED == 0:
            found = written(found, "found")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
