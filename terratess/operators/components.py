"""Connected components of a link table by contraction, without collecting links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.staging import release, stage


def _through(links: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """Replaces ``column`` by its parent where it has one."""
    p = up.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return links.join(p, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links in memory, and the smallest node reachable from each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up


def _in_one_task(group: pd.DataFrame) -> pd.DataFrame:
    node, label = joined(group["a"].to_numpy(), group["b"].to_numpy())
    return pd.DataFrame({"node": node, "label": label})


def components(links: DataFrame, in_task: int = 0) -> DataFrame:
    """``links (a, b)`` to ``(node, label)``: the smallest node reachable, for every linked node.

    Each round hooks every node to its smallest neighbour, jumps pointers twice
    and contracts the links; hooks go downwards only, so rounds end, and a star
    takes two. Hot nodes meet staged tables only, in joins that can be split.
    Self links and repeated links are allowed; no links give no rows. Links that
    number at most ``in_task``, a bound on one task's memory, are joined in one task
    instead of in rounds, with the same result.
    """
    left = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    if in_task and left.count() <= in_task:
        return left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_in_one_task, "node long, label long")
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node"), "hooks")
        for _ in range(2):
            flat = stage(_through(up, up, "parent"), "jumps")
            release(up)
            up = flat
        # a parent that is itself hooked elsewhere stays a node of the next round
        moved = up if label is None else _through(label.withColumnRenamed("label", "parent"), up, "parent").unionByName(up)
        fresh = stage(moved.groupBy("node").agg(F.min("parent").alias("label")), "labels")
        release(label)
        label = fresh
        rest = _through(_through(left, up, "a"), up, "b").where("a <> b").distinct()
        rest = stage(rest, "links")
        release(left, up)
        left = rest
    release(left)
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    roots = label.select(F.col("label").alias("node")).distinct().join(label.select("node"), "node", "left_anti")
    return label.unionByName(roots.withColumn("label", F.col("node")))
