"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packlens.llm.common import staged


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b); the component is its least node.

    Rounds of large-star and small-star steps: every node hands its neighbours to the least node
    among them, which leaves as many edges at most as before. Each step is an aggregation by node
    (partial in the tasks, so a node with many neighbours costs one row for a task) and a join on
    the node. The least neighbours are written before the join, so that Spark can split the rows of a
    node that has most of them. Each round is written to the shared folder.
    Stops as soon as a round changes nothing; raises after ``rounds`` rounds.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _state(now)
        if after == before:
            # Stars: every node but the least of a component has one edge, to that least node.
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"components not found in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
