"""Connected components: within one task on index arrays, and over all tasks by alternating stars.

The distributed part never gathers links anywhere: each round is a grouped minimum and two joins on the node, so
a hub's links are split by Spark's skew join, and each round ends in a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots(n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of each component under links a-b; known: roots found before."""
    at = np.arange(n) if known is None else known.copy()
    while len(a):
        x, y = at[a], at[b]
        if not (open_ := x != y).any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(at, np.maximum(x, y), np.minimum(x, y))
        while (at[at] != at).any():
            at = at[at]
    return at


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) of any one orderable type to (node, root), the smallest node reachable, for nodes that have a link.

    Null ends and links of a node with itself are left out; repeated links count once; no link gives no row.
    """
    stars = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now or not now["n"]:
            break
        before = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = cut(small)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
