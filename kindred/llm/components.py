"""Connected components of a link table, without the links ever leaving the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import forget, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and then its label's label, so long chains
    shorten by doubling. Labels are written to the shared folder after each round; the driver only learns how many
    changed.
    """
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("comp")),
        "labels",
    )
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
        low = seen.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        mine = labels.select("node", "comp").join(low, "node").select("node", "comp", F.least("comp", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = mine.join(jump, "next").select("node", F.col("comp").alias("was"), F.least("next", "far").alias("comp"))
        new = materialise(moved, "labels")
        forget(labels)
        labels = new
        if not labels.filter("was != comp").limit(1).count():
            forget(both)
            return labels.select("node", "comp")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) connect, one for each node but the smallest of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]
