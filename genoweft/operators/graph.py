"""Connected parts of a graph of factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Workspace


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every end of edges(i, j): the least node reachable.

    Each round a node takes the least label of its neighbours, then its label's own label, so chains
    shorten by half. Every round is a written table; nothing is collected but whether labels moved."""
    work = Workspace(edges.sparkSession, "parts")
    both = work.write(edges.select(F.col("i").alias("node"), F.col("j").alias("to")).union(edges.select("j", "i")).where("node <> to").distinct())
    now = work.write(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("node").alias("to"), "component"), "to").groupBy("node").agg(F.min("component").alias("least"))
        low = now.join(near, "node").select("node", F.least("component", "least").alias("label"), F.col("component").alias("before"))
        jump = now.select(F.col("node").alias("label"), F.col("component").alias("further"))
        after = work.write(low.join(jump, "label").select("node", F.least("label", "further").alias("component"), "before"))
        moved = not after.where("component <> before").isEmpty()
        work.drop(now)
        now = after
        if not moved:
            work.drop(both)
            return now.select("node", "component")
    raise RuntimeError("components did not settle")
