"""Connected components of a graph in DataFrames, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then that label's own label. Messages to a node
    are minima, so a node with very many edges gets one row from each task. Rounds are written and
    reread; their number grows with the logarithm of the longest chain.
    """
    both = work.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = work.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        new = lower.join(jump, lower["label"] == jump["j_node"], "left").select("node", "old", F.least("label", F.coalesce("j_label", "label")).alias("label"))
        new = work.put(new, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            work.drop(f"{name}-both")
            return labels
