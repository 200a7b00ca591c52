"""Connected components: a vectorised one for a task's own rows, and a distributed one of joins and minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def connected_components(edges: DataFrame, staged: Staged) -> DataFrame:
    """edges (u, v) of longs to one row (node, root) for every node but the roots; root is the smallest node of the component.

    Rounds of large-star and small-star: every node links its larger neighbours to the least node it sees,
    then its smaller ones. Only minima are gathered, so a node with very many links
    is a sum of partial minima and a join that is split, never a list.
    """
    e = staged.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        link = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        link = link.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        after = staged.put(link.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now != state:
            staged.drop(e)
        if now == state or now[0] == 0:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e, state = after, now
