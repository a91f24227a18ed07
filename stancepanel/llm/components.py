"""Connected components of a link table, as joins and aggregations in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import stage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b); keys are whole numbers.

    Each round points every node to the smallest node next to it, then points all links at these. A round's links are
    written to the shared folder; it ends when every link already goes to a component's smallest node. Links with a null
    end are not links. An empty table gives an empty result.
    """
    both = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct()
    current = stage(both, "links")
    for _ in range(rounds):
        # Large star: every neighbour above a node goes to the smallest of the node and its neighbours.
        around = current.select("node", "to").unionAll(current.select(F.col("to").alias("node"), F.col("node").alias("to")))
        # The minima are written, so that the join reads both sides as they are and Spark can split a hot node's rows.
        lowest = stage(around.groupBy("node").agg(F.min("to").alias("low")).select(
            "node", F.least("node", "low").alias("low")), "lowest")
        large = (around.join(lowest, "node").where(F.col("to") > F.col("node"))
                 .select(F.col("to").alias("node"), F.col("low").alias("to")).distinct())
        large = stage(large, "links")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = stage(large.groupBy("node").agg(F.min("to").alias("low")), "lowest")
        small = (large.join(least, "node")
                 .select(F.explode(F.array(F.struct("node", F.col("low").alias("to")),
                                           F.struct(F.col("to").alias("node"), F.col("low").alias("to")))).alias("l"))
                 .select("l.node", "l.to").where("node <> to").distinct())
        after = stage(small, "links")
        if _same(current, after):
            return after.select("node", F.col("to").alias("component")).unionAll(
                after.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
        current = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of links are equal, by number and two sums of hashes."""
    def print_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")),
                      F.sum(F.hash("node", "to").cast("long"))).first()
    return print_of(a) == print_of(b)
