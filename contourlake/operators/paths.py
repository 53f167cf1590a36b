"""Shortest paths: one task for each project key, or relaxation rounds over tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels.topology import cheapest_path
from .common import cut, discard, temporary

#: Edges of a graph that one task may hold.
TASK_EDGES = 2_000_000


def weighted_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """src, dst, w: edges(src, dst) with the distance of their points(v, p)."""
    from ..functions.columns import squared_distance

    a, b = points.select(F.col("v").alias("src"), F.col("p").alias("pa")), points.select(F.col("v").alias("dst"), F.col("p").alias("pb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.sqrt(squared_distance(F.col("pa"), F.col("pb"))).alias("w"))


def shortest_path(weighted: DataFrame, starts: list[int], ends: list[int]) -> DataFrame:
    """weighted(key, src, dst, w) -> key, step, v, cost (of the whole path): the cheapest of the paths from any start to any end, both ends included.

    In a task for each key where every key has at most ``TASK_EDGES`` edges, else over tables; ties go to the lesser (cost, vertex) in both.
    """
    weighted = cut(weighted.select("key", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")), "weighted")
    if not weighted.groupBy("key").count().filter(F.col("count") > TASK_EDGES).isEmpty():
        return path_by_tables(weighted, starts, ends)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["src"]) | set(rows["dst"]) | set(starts) | set(ends))
        at = {v: i for i, v in enumerate(names)}
        cost, path = cheapest_path(len(names), [(at[a], at[b], w) for a, b, w in zip(rows["src"], rows["dst"], rows["w"], strict=True)], [at[s] for s in starts], [at[e] for e in ends])
        return pd.DataFrame({"key": key[0], "step": range(len(path)), "v": [names[i] for i in path], "cost": cost})

    return weighted.groupBy("key").applyInPandas(run, "key string, step int, v long, cost double")


def path_by_tables(weighted: DataFrame, starts: list[int], ends: list[int]) -> DataFrame:
    """:func:`shortest_path` for graphs of any size and weights of 0 or more.

    Rounds of relaxation from the vertices that became cheaper, until none does; each vertex keeps the round of its cost. A vertex's predecessor is the least (cost, vertex) of the neighbours whose cost and edge make up its own and that are cheaper,
    or as cheap and of an earlier round. The path is read back from the end by doubling: after i joins it has its last 2^i vertices.
    """
    with temporary(weighted.sparkSession) as keep:
        return keep(_path(weighted, starts, ends), "path")


def _path(weighted: DataFrame, starts: list[int], ends: list[int]) -> DataFrame:
    both = weighted.unionByName(weighted.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = cut(both.groupBy("key", "src", "dst").agg(F.min("w").alias("w")), "both")
    given = lambda vs: F.explode(F.array(*(F.lit(v).cast("long") for v in vs))).alias("v")
    keys = cut(weighted.select("key").distinct(), "keys")
    costs = cut(keys.select("key", given(starts)).distinct().select("key", "v", F.lit(0.0).alias("cost"), F.lit(0).alias("round")), "costs")
    front, turn = costs, 0
    while not front.isEmpty():
        turn += 1
        offers = front.select("key", F.col("v").alias("src"), "cost").join(both, ["key", "src"]).groupBy("key", F.col("dst").alias("v")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        found = offers.join(costs, ["key", "v"], "left").filter("cost IS NULL OR offer < cost").select("key", "v", F.col("offer").alias("cost"), F.lit(turn).alias("round"))
        after = cut(found, "front")
        if not after.isEmpty():
            whole = cut(costs.join(after, ["key", "v"], "left_anti").unionByName(after), "costs")
            discard(costs)
            costs = whole
        front = after
    goal = costs.join(keys.select("key", given(ends)).distinct(), ["key", "v"]).groupBy("key").agg(F.min(F.struct("cost", "v", "round")).alias("g"))
    end = lambda c: costs.select("key", F.col("v").alias(c), F.col("cost").alias(f"cost_{c}"), F.col("round").alias(f"round_{c}"))
    steps = both.join(end("src"), ["key", "src"]).join(end("dst"), ["key", "dst"]).filter("cost_dst > 0 OR round_dst > 0").filter("cost_src + w = cost_dst AND (cost_src < cost_dst OR round_src < round_dst)")
    before = cut(steps.groupBy("key", F.col("dst").alias("v")).agg(F.min(F.struct("cost_src", "src")).alias("b")).select("key", "v", F.col("b.src").alias("p")), "before")
    path = cut(goal.select("key", F.col("g.v").alias("v")), "path")
    while True:
        more = cut(path.join(before, ["key", "v"]).select("key", F.col("p").alias("v")), "path")
        if more.isEmpty():
            break
        path = cut(path.unionByName(more), "path")
        before = cut(before.join(before.select("key", F.col("v").alias("p"), F.col("p").alias("further")), ["key", "p"]).select("key", "v", F.col("further").alias("p")), "before")
    order = Window.partitionBy("key").orderBy("cost", "round", "v")
    placed = path.join(costs, ["key", "v"]).withColumn("step", F.row_number().over(order) - 1)
    return placed.select("key", "step", "v").join(goal.select("key", F.col("g.cost").alias("cost")), "key")


def path_costs(weighted: DataFrame, start: int) -> DataFrame:
    """weighted(src, dst, w) -> v, cost from the start, by rounds of relaxation over tables: for graphs larger than a task. Stops when nothing improves."""
    with temporary(weighted.sparkSession) as keep:
        return keep(_costs(weighted, start), "costs")


def _costs(weighted: DataFrame, start: int) -> DataFrame:
    both = cut(weighted.select("src", "dst", "w").unionByName(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "weighted")
    costs = cut(weighted.sparkSession.createDataFrame([(start, 0.0)], "v long, cost double"), "costs")
    front = costs
    while True:
        offers = front.join(both, F.col("v") == F.col("src")).groupBy(F.col("dst").cast("long").alias("v")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        front = cut(offers.join(costs, "v", "left").filter("cost IS NULL OR offer < cost").select("v", F.col("offer").alias("cost")), "front")
        if front.isEmpty():
            return costs
        whole = cut(costs.join(front, "v", "left_anti").unionByName(front), "costs")
        # The first front is the first table of costs.
        discard(costs)
        costs = whole


def common_steps(path: DataFrame, other: DataFrame) -> DataFrame:
    """The steps of a path that the other one visits too, in the order of the first."""
    return path.join(other.select("v").distinct(), "v", "left_semi").select("step", "v")


def ring_neighbours(items: DataFrame, order: str) -> DataFrame:
    """idx, name, next, previous of a list of items, wrapping around."""
    w = Window.orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rows = items.select(order, (F.row_number().over(w) - 1).alias("idx"), n.alias("n"))
    return rows.select(order, "idx", F.pmod(F.col("idx") + 1, F.col("n")).alias("next"), F.pmod(F.col("idx") - 1, F.col("n")).alias("previous"))


def boundary_path(path: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """step, v: a path with a further vertex in front and behind where one is given, as when it runs between groups of vertices of which one is picked."""
    ends = [(step, v) for step, v in ((-1, start), (2**31 - 1, end)) if v is not None]
    own = path.select("step", F.col("v").cast("long").alias("v"))
    if ends:
        # An empty path stays empty.
        more = path.sparkSession.createDataFrame(ends, "step int, v long").join(F.broadcast(path.agg((F.count(F.lit(1)) > 0).alias("_any")).filter("_any")))
        own = own.unionByName(more.select("step", "v"))
    return own.select((F.row_number().over(Window.orderBy("step")) - 1).alias("step"), "v")  # one path
