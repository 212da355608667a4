"""Connected components of an edge table by minimum labels and pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, written


def contracted(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(a, b), a >= b: edges that connect the same nodes as ``edges`` (a, b), hardly more than there are nodes.

    Each round every node keeps the edge to its smallest lower neighbour and hands the others to
    that neighbour, which connects what they connected; what a round hands on is a fraction of what
    it got.  What is left after ``rounds`` rounds is passed on as it is.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    left = written(edges.select(high.alias("a"), low.alias("b")).distinct(), "edges")
    out = left.filter("a = b")
    for _ in range(rounds):
        open_ = left.filter("a > b")
        kept = written(open_.groupBy("a").agg(F.min("b").alias("low")), "edges")
        out = out.unionByName(kept.withColumnRenamed("low", "b"))
        left = written(open_.join(kept, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return out
    return out.unionByName(left)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    Edges are undirected; repeated edges, loops and an empty table are fine.  Each round takes
    the smallest label among the neighbours, then the label of the own label's node, until
    nothing changes; the labels of each round are a written table.  Parallel paths are contracted
    before, so that the rounds join about as many edges as there are nodes.
    """
    few = contracted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    both = few.select(F.col("a").alias("node"), F.col("b").alias("other")).union(few.select("b", "a"))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"), F.lit(True).alias("changed")), "labels")
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = step.join(jump, "label").select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") != F.col("old")).alias("changed"))
        after = written(step, "labels")
        forget(labels)
        labels = after
    forget(both)
    return labels.select("node", "label")
