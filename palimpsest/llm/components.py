"""Connected components of links that are spread over a cluster.

Each round lets every node's larger neighbours, then its smaller ones, point at its smallest neighbour (large star and small
star); the number of rounds grows with the logarithm of the number of nodes. A round's links go to the checkpoint folder.
The least neighbour of each node is broadcast if there are ``BROADCAST_LINKS`` links at most, a pair of nodes each, so that no task
gets all links of a large component; more are written as a table, which lets Spark split these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint

MAX_ROUNDS, BROADCAST_LINKS = 60, 1 << 18


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of some nodes reduced to one for each node but the smallest of its component: (node, smallest)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, x, low)
            np.minimum.at(new, label[x], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """links: (a, b) with a > b. Large: neighbours over a node; small: its neighbours below it and itself. few: they may be broadcast."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        low = low.withColumn("m", F.least("a", "m"))
    low = F.broadcast(low) if few else checkpoint(low)
    if large:
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the rows (node, component) of every node that isn't the smallest of its component.

    Links from a node to itself have no effect; nulls are left out; without links the result is empty.
    """
    kind = links.schema["a"].dataType
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = checkpoint(links), None
    few = links.count() <= BROADCAST_LINKS  # a round never makes more of them
    for _ in range(MAX_ROUNDS):
        links = checkpoint(_star(_star(links, True, few), False, few))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
