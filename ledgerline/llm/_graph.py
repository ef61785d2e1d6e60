"""Connected components of an edge table, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._work import join_skewed, release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges (a, b)`` with its component's least node.

    Each round takes the least label among the neighbours and then the label
    of that label, so long chains halve; it ends at the fixed point.  Labels
    and edges stay distributed; every round is written to the shared folder.
    A node with a large part of all edges, or a label with a large part of all
    nodes, is joined apart (:func:`join_skewed`).
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "edges")
    degree = stored(both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("degree")), "degree")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        far = labels.join(degree.hint("shuffle_merge"), "node").select(F.col("node").alias("b"), "label", "degree")
        near = join_skewed(both, far, ["b"], size="degree").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = stored(labels.join(near.hint("shuffle_merge"), "node").select("node", "label", F.least("label", "near").alias("new")), "near")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("further"))
        least = F.least("new", F.coalesce("further", "new"))
        done = stored(join_skewed(new, jump, ["new"], "left").select("node", least.alias("label"), (least != F.col("label")).alias("moved")), "labels")
        release(labels, new)
        labels = done
        if not done.where("moved").limit(1).count():
            release(both, degree)
            return labels.select("node", "label")
