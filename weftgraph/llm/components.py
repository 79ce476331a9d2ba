"""Connected components of a graph given as a table of links, for graphs that fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cluster import cut


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long); root is the smallest node that it reaches.

    Parents are hooked to smaller grandparents and shortened every round (the FastSV scheme), which takes about
    log2 of the longest path in rounds. Parents are a written table after each round. Joins whose keys may be very
    frequent stand right above their shuffles, so that the adaptive skew join can split them, and minima are taken
    in every task before the shuffle. Self links give their node; null ends are ignored; an empty table gives an
    empty one.
    """
    links = links.where("a is not null and b is not null")
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")
    edges = cut(links.select(both).select("x.u", "x.v"))
    parents = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("parent")))
    for _ in range(rounds):
        grand = parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        low = edges.join(grand.select(F.col("node").alias("v"), "grand"), "v").groupBy(F.col("u").alias("node")).agg(F.min("grand").alias("low"))
        least = F.least("low", "grand").alias("to")
        hooks = grand.join(low, "node").select(F.explode(F.array(F.struct("node", least), F.struct(F.col("parent").alias("node"), least))).alias("x"))
        parents, old = cut(hooks.groupBy(F.col("x.node").alias("node")).agg(F.min("x.to").alias("parent"))), parents
        if not old.join(parents.withColumnRenamed("parent", "now"), "node").where("now != parent").limit(1).count():
            return parents.withColumnRenamed("parent", "root")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
