"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node of edges(a, b).

    Each round points every node at its least neighbour, follows such pointers
    twice, and joins the edges' ends with them; edges inside one label go. Rounds
    end when no edge is left; each one's tables lie in the shared folder, and only the
    last labels stay there.
    """
    live = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        near = least = written(near, "near")
        for _ in range(2):
            on = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
            near = near.join(on, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        jump = written(near, "jump")
        left, right = jump.toDF("a", "x"), jump.toDF("b", "y")
        ends = live.join(left, "a").join(right, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        live_next = written(ends.distinct(), "edges")
        if labels is None:
            joined = jump.select("node", F.col("to").alias("label"))
        else:
            on = jump.select(F.col("node").alias("label"), F.col("to").alias("far"))
            joined = labels.join(on, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
        labels_next = written(joined, "labels")
        dropped(live, least, jump, *([labels] if labels is not None else []))
        live, labels = live_next, labels_next
    if labels is None:
        labels = live.toDF("node", "label")  # none
    else:
        dropped(live)
    return labels
