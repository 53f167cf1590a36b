"""Contour trees over tables: rake and compress on (vertex, join parent, split parent), plateaus, critical edges, simplification.

All vertices are ranks of :func:`merge.ranked_domains`. Domains whose rows fit a task (``TASK_ROWS``) are merged there by the kernel; larger ones go through rounds until what is left of them fits. A round takes every chain
that ends in a leaf: an upper leaf (no child in the join tree, one in the split tree) with the vertices below it that have one child in either tree, and the same from below. The vertices of
a chain hang on each other as the trees say, and pointers that led through them are led on. Chains are walked by doubling, and where two merge trees have a contour tree it is unique, so rounds and kernel give the same arcs.
A round takes all leaves, so there are as many rounds as branches nest; a branch that turns up and down again (a path of many hills) opens one hill a round.

Merge trees of a domain with cycles may have no contour tree. Then leaves contradict each other, and the result depends on their order: the kernel takes them by rank; a round
leaves an upper chain that contradicts a lower one for later, and where a domain has no leaf it takes one vertex as the kernel does.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import topology
from .common import cut, discard, numbered, temporary
from .graph import chain_ends, connected_components
from .merge import merge_tables, named_pairs
from .neighbours import node_class

#: Vertices of a domain that one task may hold.
TASK_ROWS = 1_000_000


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rank")
    ranks = rows["rank"].to_numpy()
    at = {r: i for i, r in enumerate(ranks.tolist())}
    parents = [[-1 if pd.isna(p) else at[int(p)] for p in rows[c]] for c in ("pj", "ps")]
    arcs = topology.combine(*parents)
    return pd.DataFrame({"lo": [ranks[a] for a, _ in arcs], "hi": [ranks[b] for _, b in arcs]}, dtype="int64")


def _round(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs(lo, hi), what is left) of live(key, rank, pj, ps). In the work below an id is twice a rank, and one more in the split tree."""
    children = lambda p, name: live.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("rank")).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("rank").alias(f"c_{name}"))
    known = live.join(children("pj", "j"), "rank", "left").join(children("ps", "s"), "rank", "left").fillna(0, ["n_j", "n_s"])
    known = cut(known, "live")
    regular, upper, lower = (F.col("n_j") == 1) & (F.col("n_s") == 1), (F.col("n_j") == 0) & (F.col("n_s") == 1), (F.col("n_j") == 1) & (F.col("n_s") == 0)
    # From each regular vertex up the join tree, and down the split tree, to the first that is not regular.
    steps = known.filter(regular).select(F.explode(F.array(F.struct((F.col("rank") * 2).alias("id"), (F.col("c_j") * 2).alias("to")), F.struct((F.col("rank") * 2 + 1).alias("id"), (F.col("c_s") * 2 + 1).alias("to")))).alias("s")).select("s.id", "s.to")
    ends = chain_ends(steps)
    leaves = known.filter(upper | lower).select((F.col("rank") * 2 + F.when(upper, 0).otherwise(1)).alias("end"))
    taken = ends.join(leaves, "end", "left_semi").select("id").unionByName(leaves.select(F.col("end").alias("id")))
    taken = taken.groupBy(F.shiftright("id", 1).alias("rank")).agg(F.max(F.col("id") % 2 == 0).alias("down"), F.max(F.col("id") % 2 == 1).alias("up"))
    marked = known.join(taken, "rank", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("down", "up")})
    # An arc that only one of its ends names, both taken: the upper one waits.
    falls, rises = marked.filter("down").select("rank", "pj"), marked.filter("up").select(F.col("rank").alias("low"), "ps")
    waits = falls.join(rises, F.col("pj") == F.col("low")).filter(~F.col("ps").eqNullSafe(F.col("rank"))).select("rank")
    waits = waits.unionByName(rises.join(falls, F.col("ps") == F.col("rank")).filter(~F.col("pj").eqNullSafe(F.col("low"))).select("rank")).distinct()
    marked = marked.join(waits.withColumn("_waits", F.lit(True)), "rank", "left").withColumn("down", F.col("down") & F.col("_waits").isNull())
    # A vertex for each domain without a leaf.
    order = F.struct(F.when((F.col("n_j") == 0) & (F.col("n_s") == 0), 0).when(regular, 1).otherwise(2).alias("kind"), F.col("rank").alias("first"))
    stuck = marked.groupBy("key").agg(F.max(F.col("down") | F.col("up")).alias("_any"), F.min(order).alias("_pick")).filter("NOT _any").select("key", "_pick")
    marked = marked.join(stuck, "key", "left").withColumn("_is", F.coalesce(F.col("_pick.first") == F.col("rank"), F.lit(False)))
    marked = marked.withColumn("down", F.col("down") | (F.col("_is") & (F.col("_pick.kind") == 0))).withColumn("up", F.col("up") | (F.col("_is") & (F.col("_pick.kind") > 0)))
    marked = cut(marked.select("key", "rank", "pj", "ps", "down", "up"), "marked")
    arcs = marked.filter("down AND pj IS NOT NULL").select(F.col("pj").alias("lo"), F.col("rank").alias("hi")).unionByName(marked.filter("up AND ps IS NOT NULL").select(F.col("rank").alias("lo"), F.col("ps").alias("hi")))
    arcs = cut(arcs.distinct(), "arcs")
    # Parents of the rest: past those that were taken. A chain that ends at a taken root has no parent left.
    gone = marked.filter("down OR up")
    past = gone.select(F.explode(F.array(F.struct((F.col("rank") * 2).alias("id"), (F.col("pj") * 2).alias("to")), F.struct((F.col("rank") * 2 + 1).alias("id"), (F.col("ps") * 2 + 1).alias("to")))).alias("s")).select("s.id", F.coalesce("s.to", F.lit(-1).cast("long")).alias("to"))
    beyond = chain_ends(past)
    left = marked.filter("NOT down AND NOT up").select("key", "rank", "pj", "ps")
    for p, odd in (("pj", 0), ("ps", 1)):
        on = beyond.filter(F.col("id") % 2 == odd).select(F.shiftright("id", 1).alias(p), F.col("end"))
        left = left.join(on, p, "left").withColumn(p, F.when(F.col("end").isNull(), F.col(p)).when(F.col("end") >= 0, F.shiftright("end", 1))).drop("end")
    left = cut(left.select("key", "rank", "pj", "ps"), "parents")
    discard(known, ends, marked, beyond)
    return arcs, left


def combined(parents: DataFrame, task_rows: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """parents(key, rank, pj, ps) -> (arcs(lo, hi) of the augmented contour trees, rounds taken). Raises if a domain has more than one component."""
    live, done, rounds = cut(parents.select("key", "rank", "pj", "ps"), "parents"), [], 0
    if not live.groupBy("key").agg(F.count_if(F.col("pj").isNull()).alias("roots")).filter("roots > 1").isEmpty():
        raise ValueError("the domain has more than one component")
    while True:
        # Domains, not vertices: those too large for a task.
        large = live.groupBy("key").count().filter(F.col("count") > task_rows).select("key")
        if large.isEmpty():
            rest = live.groupBy("key").applyInPandas(lambda key, rows: _finish(rows), "lo long, hi long")
            for arcs in done:
                rest = rest.unionByName(arcs)
            return rest, rounds
        kept = live.join(large, "key", "left_anti")
        arcs, left = _round(live.join(large, "key", "left_semi"))
        done.append(arcs)
        live, rounds = cut(left.unionByName(kept), "parents"), rounds + 1


def degrees(arcs: DataFrame) -> DataFrame:
    """rank, up, down, node_class of arcs(lo, hi)."""
    ends = arcs.select(F.col("lo").alias("rank"), F.lit(1).alias("u"), F.lit(0).alias("d")).unionByName(arcs.select(F.col("hi").alias("rank"), F.lit(0).alias("u"), F.lit(1).alias("d")))
    return ends.groupBy("rank").agg(F.sum("u").alias("up"), F.sum("d").alias("down")).withColumn("node_class", node_class(F.col("up"), F.col("down")))


def without_plateaus(own: DataFrame, arcs: DataFrame) -> DataFrame:
    """Connected vertices of one value with an extremum among them become a chain by rank: what was above hangs on its top, what was below on its foot."""
    f = own.select("rank", "f")
    level = arcs.join(f.toDF("lo", "f_lo"), "lo").join(f.toDF("hi", "f_hi"), "hi").filter("f_lo = f_hi").select("lo", "hi")
    level = cut(level, "level")
    if level.isEmpty():
        return arcs
    inside = cut(connected_components(level.toDF("a", "b")), "plateaus")
    extrema = degrees(arcs).filter("up + down = 1").select(F.col("rank").alias("node"))
    held = inside.join(inside.join(extrema, "node", "left_semi").select("component").distinct(), "component", "left_semi")
    held = cut(numbered(held, [F.col("component"), F.col("node")], "place", kind="long"), "plateaus")
    chain = held.select("component", "place", F.col("node").alias("lo")).join(held.select("component", (F.col("place") - 1).alias("place"), F.col("node").alias("hi")), ["component", "place"]).select("lo", "hi")
    ends = held.groupBy("component").agg(F.min("node").alias("foot"), F.max("node").alias("top"))
    of = held.select("node", "component").join(ends, "component")
    rest = arcs.join(of.select(F.col("node").alias("lo"), F.col("component").alias("c_lo"), "top"), "lo", "left").join(of.select(F.col("node").alias("hi"), F.col("component").alias("c_hi"), "foot"), "hi", "left")
    rest = rest.filter("NOT coalesce(c_lo = c_hi, false)").select(F.coalesce("top", "lo").alias("lo"), F.coalesce("foot", "hi").alias("hi"))
    return cut(rest.unionByName(chain), "arcs")


def critical_tables(own: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, edge_id, n1, n2), (key, edge_id, rank, both ends included)) in ranks: the critical tree, edges numbered in each domain by (n1, n2)."""
    kinds = cut(degrees(arcs), "degrees")
    ordinary = kinds.filter("node_class = 'ordinary'").select("rank")
    # Each ordinary vertex has one arc up (even ids) and one down (odd ids).
    up = arcs.join(ordinary.withColumnRenamed("rank", "lo"), "lo", "left_semi").select((F.col("lo") * 2).alias("id"), (F.col("hi") * 2).alias("to"))
    down = arcs.join(ordinary.withColumnRenamed("rank", "hi"), "hi", "left_semi").select((F.col("hi") * 2 + 1).alias("id"), (F.col("lo") * 2 + 1).alias("to"))
    ends = chain_ends(up.unionByName(down))
    between = ends.groupBy(F.shiftright("id", 1).alias("rank")).agg(F.max(F.when(F.col("id") % 2 == 1, F.shiftright("end", 1))).alias("n1"), F.max(F.when(F.col("id") % 2 == 0, F.shiftright("end", 1))).alias("n2"))
    between = cut(between, "between")
    first = arcs.join(ordinary.withColumnRenamed("rank", "lo"), "lo", "left_anti").join(between.select(F.col("rank").alias("hi"), F.col("n2")), "hi", "left")
    edges = first.select(F.col("lo").alias("n1"), F.coalesce("n2", "hi").alias("n2")).join(own.select("key", F.col("rank").alias("n1")), "n1")
    edges = cut(numbered(edges.select("key", "n1", "n2"), [F.col("n1"), F.col("n2")], "place", kind="long"), "critical")
    start = edges.groupBy("key").agg(F.min("place").alias("start"))
    edges = cut(edges.join(start, "key").select("key", (F.col("place") - F.col("start")).cast("int").alias("edge_id"), "n1", "n2"), "critical")
    members = between.join(edges, ["n1", "n2"]).select("key", "edge_id", "rank").unionByName(edges.select("key", "edge_id", F.explode(F.array("n1", "n2")).alias("rank")))
    discard(kinds, ends)
    return edges, members


def contour_tables(vertices: DataFrame, edges: DataFrame, tau: float | None = None, task_rows: int = TASK_ROWS, slabs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(domain(key, v, f, rank), arcs(lo, hi)): the augmented contour tree, simplified below tau if that is given.

    Simplification: pairs of a persistence below tau, of the tree's own arcs, each add a shortcut from the extremum to the one that survives it; the tree of those arcs and shortcuts is the result. The pairs come
    from one table whatever tau is.
    """
    with temporary(vertices.sparkSession) as keep:
        own, parents, _ = merge_tables(vertices, edges, slabs)
        arcs = cut(without_plateaus(own, cut(combined(parents, task_rows)[0], "arcs")), "arcs")
        if tau is not None:
            arcs = _simplified(own, arcs, tau, task_rows, slabs)
        return keep(own, "domain"), keep(arcs, "arcs")


def _simplified(own: DataFrame, arcs: DataFrame, tau: float, task_rows: int, slabs: int | None) -> DataFrame:
    # The arcs of the tree are their own domain, in ranks, which keep the order of (f, id).
    named = own.select("key", F.col("rank").alias("v"), "f")
    keyed = arcs.join(own.select("key", F.col("rank").alias("lo")), "lo").select("key", F.col("lo").alias("src"), F.col("hi").alias("dst"))
    again, _, pairs = merge_tables(named, keyed, slabs)
    short = named_pairs(again, pairs).filter(F.col("persistence") < tau).select("key", F.col("extremum").alias("src"), F.col("killed_by").alias("dst"))
    short = cut(short, "shortcuts")
    if short.isEmpty():
        return arcs
    whole, parents, _ = merge_tables(named, keyed.unionByName(short), slabs)
    found = without_plateaus(whole, cut(combined(parents, task_rows)[0], "arcs"))
    back = whole.select("rank", F.col("v").alias("r"))
    return found.join(back.toDF("lo", "a"), "lo").join(back.toDF("hi", "b"), "hi").select(F.col("a").alias("lo"), F.col("b").alias("hi"))


def contour_arcs(vertices: DataFrame, edges: DataFrame, tau: float | None = None, **sizes) -> DataFrame:
    """key, lo, hi in vertex ids."""
    own, arcs = contour_tables(vertices, edges, tau, **sizes)
    at = lambda c, *more: own.select(F.col("rank").alias(c), F.col("v").alias(f"v_{c}"), *more)
    return arcs.join(at("lo", "key"), "lo").join(at("hi"), "hi").select("key", F.col("v_lo").alias("lo"), F.col("v_hi").alias("hi"))


def critical_tree(vertices: DataFrame, edges: DataFrame, tau: float | None = None, **sizes) -> tuple[DataFrame, DataFrame]:
    """((key, edge_id, n1, n2), (key, edge_id, v)) in vertex ids: the critical tree and its members, one row each, both ends of an edge included."""
    with temporary(vertices.sparkSession) as keep:
        own, arcs = contour_tables(vertices, edges, tau, **sizes)
        tree, members = critical_tables(own, arcs)
        at = lambda c: own.select(F.col("rank").alias(c), F.col("v").alias(f"v_{c}"))
        tree = tree.join(at("n1"), "n1").join(at("n2"), "n2").select("key", "edge_id", F.col("v_n1").alias("n1"), F.col("v_n2").alias("n2"))
        return keep(tree, "tree"), keep(members.join(at("rank"), "rank").select("key", "edge_id", F.col("v_rank").alias("v")), "members")
