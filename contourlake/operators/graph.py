"""Connected components and ends of chains of tables of any size: rounds of joins, each partition first doing what it can by itself."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Rows that a task looks at together.
ROWS = 1 << 20
#: Edges that one task may hold to the end.
TASK_ROWS = 1 << 21


def _gathered(batches, rows: int):
    """Pairs of columns of up to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield tuple(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes joined by edges a-b, the smallest that each reaches."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _stars(batches, rows: int):
    """Each part of the edges as stars around its least nodes."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for a, b in _gathered(batches, rows):
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = least_reachable(at[: len(a)], at[len(a) :], len(names))
        hung = np.flatnonzero(low != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[low[hung]])], schema=schema)


def _open(stars: DataFrame) -> tuple[bool, int]:
    """Whether a node hangs on two others, or on one that hangs itself; and how many edges there are."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    open_, n = nodes.agg(F.count_if(F.expr("hangs > 1 OR (hangs = 1 AND holds = 1)")), F.coalesce(F.sum("hangs"), F.lit(0))).first()
    return open_ > 0, n


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """edges(a long, b long) -> node, component: every node that has an edge to another, with the smallest node reachable from it.

    Edges are undirected; loops, repeats and nulls are ignored. Alternating large-star and small-star rounds until all are stars or what is left fits a task (``TASK_ROWS``), which ends it; only a flag and a count a
    round reach the driver, and only the last round's table stays.
    """
    pairs = edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    current = cut(pairs.mapInArrow(partial(_stars, rows=ROWS), "u long, v long").distinct(), "stars")
    for _ in range(rounds):
        is_open, n = _open(current)
        if not is_open:
            break
        if n <= TASK_ROWS:
            after = cut(current.coalesce(1).mapInArrow(partial(_stars, rows=TASK_ROWS), "u long, v long"), "stars")
            discard(current)
            current = after
            break
        # Large star: neighbours above a node hang on the smallest of its neighbourhood.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "stars")
        # Small star: a node and its neighbours below it hang on the smallest of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(current, large)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _shortened(batches, rows: int):
    schema = pa.schema([("id", pa.int64()), ("end", pa.int64())])
    for ids, to in _gathered(batches, rows):
        order = np.argsort(ids)
        ids, to = ids[order], to[order]
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        onward = np.where(ids[at] == to, at, np.arange(len(ids)))
        while not ((further := onward[onward]) == onward).all():
            onward = further
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to[onward])], schema=schema)


def chain_ends(steps: DataFrame) -> DataFrame:
    """steps(id long, to long), one row an id and no cycles -> id, end: where each id arrives that has no step of its own.

    Doubling: paths shorten by half or more a round, so there are as many rounds as the logarithm of the longest chain between partitions.
    """
    current = cut(steps.select(F.col("id").cast("long"), F.col("to").cast("long")).mapInArrow(partial(_shortened, rows=ROWS), "id long, end long"), "chains")
    while True:
        onward = current.select(F.col("id").alias("end"), F.col("end").alias("further"))
        after = cut(current.join(onward, "end", "left").select("id", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "chains")
        discard(current)
        current = after.select("id", "end")
        if after.filter("moved").isEmpty():
            return current
