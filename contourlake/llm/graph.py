"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame):
    # Decimal sums do not overflow; the pair changes whenever the set of edges does.
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(a, b) -> node, component: every node that has an edge to another, with the smallest node reachable from it.

    Edges are undirected; loops, repeats and nulls are ignored. Only counts reach the driver. Each round is written to the shared folder.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, seen = materialize(ends, "edges"), None
    for _ in range(rounds):
        mark = _mark(current)
        if mark == seen or not mark[0]:
            break
        seen = mark
        # Large star: neighbours above a node hang on the smallest of its neighbourhood.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its neighbours below it hang on the smallest of those.
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(current), discard(large)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes joined by edges a-b, the smallest that each reaches: for the few nodes of one task."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low
