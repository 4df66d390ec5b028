"""Connected components of a graph of links: in one task while they are few, else by shuffled joins over stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


#: Links (32 MB of them, either way) that one task joins.
ONE_TASK = 1 << 21


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; labels[x] is the smallest member of x's class, before and after."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of the pairs (a[i], b[i]), which are apart[i] from each other, those that merged() needs to join their classes: fewer than there are members."""
    kept = [np.empty((2, 0), np.int64)]
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return np.concatenate(kept, axis=1)
        a, b, apart, low, high = a[open_], b[open_], apart[open_], np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        order = np.lexsort([low, apart, high])
        first = order[np.unique(high[order], return_index=True)[1]]  # each class joins its closest smaller neighbour by one pair
        kept.append(np.stack([a[first], b[first]]))
        labels = merged(labels, a[first], b[first])


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [batch[["a", "b"]].to_numpy(np.int64) for batch in batches]
    nodes, at = np.unique(np.concatenate([np.empty((0, 2), np.int64), *held]), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    yield pd.DataFrame({"node": nodes, "component": nodes[merged(np.arange(len(nodes)), a, b)]})


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component), component being the smallest node reachable. Nodes without a link don't come.

    Up to ONE_TASK links, which are bounded memory, are joined in one task. Beyond, each round takes the smallest label among the neighbours and then the label's own label, which halves the way. Both joins start from stored tables, so Spark can split the partitions of nodes with many links.
    """
    links = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    if links.count() <= ONE_TASK:
        return staged(links.coalesce(1).mapInPandas(_in_one_task, "node long, component long"), "labels")
    labels = staged(links.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = staged(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "lower")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = staged(lower.join(up, "component").select("node", F.col("up").alias("component"), (F.col("up") < F.col("was")).alias("moved")), "labels")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels
