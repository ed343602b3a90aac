"""Connected components of a link table, for graphs of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.scratch import materialise


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node next to the first node of its component."""
    if not len(u):
        return u, v
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for each end of ``links`` (u, v).

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so labels travel twice as far in every round. All
    tables stay distributed; each round is written to the shared folder.
    """
    links = materialise(links.where("u <> v").distinct(), "links")
    both = links.select("u", "v").union(links.select("v", "u"))
    labels = materialise(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        low = materialise(
            labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("low")),
            "roots-low",
        )
        top = low.select(F.col("node").alias("low"), F.col("low").alias("top"))
        jumped = materialise(low.join(top, "low").select("node", "old", F.col("top").alias("root")), "roots")
        moved = jumped.where("root <> old").limit(1).count()
        labels = jumped.select("node", "root")
        if not moved:
            return labels
