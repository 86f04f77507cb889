"""Connected components by alternating minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``; longs): label is the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so chains halve.  All
    steps are equi-joins and minima, which Spark combines before it shuffles; no neighbourhood is gathered.  A round's labels
    are written to the shared folder.  It ends when no label changes; labels only ever fall, so it does end.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = stored(
            new.join(above, "label").select("node", "old", F.least("label", "top").alias("label")), "labels"
        )
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connections of links ``a, b`` as stars: the smallest node of all that is connected, and each of the others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = top[i], top[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    others = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[others]], nodes[others]


def fewer_links(links: DataFrame) -> DataFrame:
    """Links ``a, b`` (a < b) that connect what ``links`` (a < b) connect.

    A node keeps one link to a smaller one, the smallest of those; the others go to that smallest one in its stead.  Where many tasks
    link the same nodes with a few small ones each, these are links among few, and equal ones become one.
    """
    held = links.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    other = F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a"))
    return held.select(F.col("least").alias("a"), other.alias("b")).distinct()
