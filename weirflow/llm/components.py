"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import BROADCAST_ROWS, cut

#: Up to so many edges, of two longs each, are labelled on the driver; beyond, by rounds of joins.
DRIVER_EDGES = BROADCAST_ROWS


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least one that each reaches."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def labelled_here(edges: DataFrame) -> DataFrame:
    """``components`` of few edges, on the driver."""
    found = edges.toArrow()
    nodes, at = np.unique(np.concatenate([found.column(c).to_numpy() for c in range(2)]), return_inverse=True)
    labels = nodes[least_reached(*at.reshape(2, -1), len(nodes))]
    kind = found.schema.field(0).type
    return cut(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, kind), "label": pa.array(labels, kind)})))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node that it reaches, for every node of an edge.

    A count tells whether the edges are few enough for the driver: the rounds' plans
    cost it more memory and time than so many edges do.  Else each round takes the labels' own labels, finds the least of them among a
    node's neighbours, and lowers to it the node and the node's label, so whole
    trees are hooked and their depth is halved.  Labels only fall; the round that
    changes none is the last.  A round is one table; nothing but whether a label
    changed reaches the driver.
    """
    once = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("node"), F.greatest(a, b).alias("other"))
    once = cut(once.distinct())
    if once.limit(DRIVER_EDGES + 1).count() <= DRIVER_EDGES:
        return labelled_here(once)
    both = once.union(once.select(F.col("other"), F.col("node")))
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = labels.join(jump, "label").select("node", "label", "next")
        near = both.join(jumped.select(F.col("node").alias("other"), "next"), "other").groupBy("node").agg(F.min("next").alias("near"))
        hooked = jumped.join(near, "node").select("node", F.col("label").alias("was"), F.least("next", "near").alias("to"))
        roots = hooked.groupBy(F.col("was").alias("node")).agg(F.min("to").alias("root"))
        after = cut(hooked.join(roots, "node", "left").select("node", "was", F.least("to", "root").alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
