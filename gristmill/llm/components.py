"""Connected components of a graph that only executors ever hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import release, settle


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Give the sets of a[i] and b[i] one label, the least index, in a batch that one task holds."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``; the component is its smallest node.

    Every round takes the least label among a node's neighbours, then the label of that label, so that labels
    travel over distances that double. All grouping is by minimum, which combines before the shuffle, and each
    round is a written table, the one before it removed: a lost executor costs that round's tasks only. No edges give no rows.
    """
    both = settle(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("component"))
    spent: tuple[DataFrame, ...] = ()
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        target = hooked.select(F.col("node").alias("at"), F.col("component").alias("next"))
        jumped = settle(hooked.join(target, hooked.component == target["at"]).select("node", F.col("next").alias("component"), "old"), "labels", spent)
        labels, spent = jumped.select("node", "component"), (jumped,)
        if jumped.where("component <> old").limit(1).count() == 0:
            release(both)
            return labels
