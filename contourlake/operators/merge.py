"""Merge trees and persistence pairs of graphs that no task can hold.

Vertices are numbered by (key, f, id) over all domains, so a domain is a range of numbers. The join tree sweeps a domain from its last vertex to its first; the
split tree does the same with the numbers turned round, and both are one problem on a line of twice as many places (the second half mirrored).

Divide and conquer over the line: places of a tree are cut into slabs of equal width. A problem is a range of slabs. Its links with both ends in the upper half say which
vertices are one component when the sweep arrives at the lower half: those components (star rounds over tables) become single vertices, each named by its last place, and
the links into the lower half are renamed and made distinct. All problems of a level are solved together, as one table of components, so there are as many levels as the logarithm of
the number of slabs. At the end each slab holds the links whose lower end it has, at most as many as it had at the start, and is swept by itself: union-find, the last place of every component that arrives
hangs on the vertex. A component also carries its oldest place (where its sweep began), so the elder rule is applied in the same pass.

A slab has about ``SLAB`` links where degrees are even. A vertex that joins very many components is one slab's work: a row of its own for each is what it returns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.topology import DisjointSets
from .common import cut, discard, numbered, temporary
from .graph import connected_components

#: Links that a slab is meant to hold.
SLAB = 2_000_000


def ranked_domains(vertices: DataFrame, edges: DataFrame, keep=cut) -> tuple[DataFrame, DataFrame]:
    """vertices(key, v, f), edges(key, src, dst) -> (key, v, f, rank), (lo, hi in ranks), both written.

    Repeated vertices count once (with their least f), loops and edges to unknown vertices not at all; a null f is the largest, as not-a-number is.
    """
    f = F.coalesce(F.col("f").cast("double"), F.lit(float("nan"))) + F.lit(0.0)
    own = vertices.filter("v IS NOT NULL").groupBy("key", F.col("v").cast("long").alias("v")).agg(F.min(f).alias("f"))
    own = keep(numbered(own, [F.col("key"), F.col("f"), F.col("v")], "rank", kind="long"), "ranked")
    at = lambda c, name: own.select("key", F.col("v").alias(c), F.col("rank").alias(name))
    pairs = edges.select("key", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")
    pairs = pairs.join(at("src", "a"), ["key", "src"]).join(at("dst", "b"), ["key", "dst"])
    return own, cut(pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")


def _sweep(table: pa.Table) -> pa.Table:
    """Links (lo, hi, top) of one slab -> (a, b, c): a hangs on b where c is null, else a dies at b and c outlives it."""
    lo, hi, top = (table.column(c).to_numpy() for c in ("lo", "hi", "top"))
    names, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    oldest = names.copy()
    np.maximum.at(oldest, at[len(lo) :], top)
    order = np.argsort(-lo, kind="stable")
    low, high = at[: len(lo)][order].tolist(), at[len(lo) :][order].tolist()
    sets, last, oldest = DisjointSets(len(names)), list(range(len(names))), oldest.tolist()
    a, b, c, i = [], [], [], 0
    while i < len(low):
        v, roots = low[i], set()
        while i < len(low) and low[i] == v:
            roots.add(sets.find(high[i]))
            i += 1
        ages = sorted(oldest[r] for r in roots)
        root = v
        for r in sorted(roots):
            a.append(last[r]), b.append(v), c.append(None)
            root = sets.union(root, r)
        for young, old in zip(ages, ages[1:]):
            a.append(young), b.append(v), c.append(old)
        last[root], oldest[root] = v, ages[-1]
    name = names.tolist()
    # Those that hang are places in ``names``; the oldest are names already.
    return pa.table({"a": pa.array([name[x] if y is None else x for x, y in zip(a, c)], pa.int64()), "b": pa.array([name[x] for x in b], pa.int64()), "c": pa.array(c, pa.int64())})


def _contract(links: DataFrame, shift: int, n: int) -> DataFrame:
    """One level: in each problem (slab >> shift) the components of its upper half become single vertices."""
    span = F.lit(2 * n).cast("long")
    links = links.withColumn("problem", F.shiftright("slab", shift)).withColumn("upper", F.shiftright("slab", shift - 1).bitwiseAND(F.lit(1)) == 1)
    code = lambda c: F.col("problem") * span + F.col(c)
    above = links.filter("upper")
    named = cut(connected_components(above.select(code("lo").alias("a"), code("hi").alias("b"))), "named")
    tops = above.select(code("lo").alias("node"), "top").join(named, "node").groupBy("component").agg(F.max("top").alias("oldest"))
    named = named.join(tops, "component").select(F.col("node").alias("_hi"), (F.col("component") - F.floor(F.col("component") / span) * span).alias("last"), "oldest")
    below = links.filter("NOT upper").withColumn("_hi", code("hi")).join(named, "_hi", "left")
    below = below.groupBy("slab", "lo", F.coalesce("last", "hi").alias("hi")).agg(F.max(F.coalesce("oldest", "top")).alias("top"))
    return below.select("lo", "hi", "top", "slab").unionByName(above.select("lo", "hi", "top", "slab"))


def swept(links: DataFrame, n: int, slabs: int | None = None) -> DataFrame:
    """links(lo, hi) in ranks below n, all trees -> (a, b, c) of :func:`_sweep` in places: ranks for the join tree, 2n - 1 - rank for the split tree."""
    if slabs is None:
        slabs = -(-links.count() // SLAB)
    levels = max(1, (slabs - 1).bit_length())
    width = max(1, -(-n >> levels))
    turned = lambda c: F.lit(2 * n - 1) - F.col(c)
    both = links.select("lo", "hi").unionByName(links.select(turned("hi").alias("lo"), turned("lo").alias("hi")))
    within = F.floor((F.col("lo") % n) / width).cast("long")
    both = both.withColumn("top", F.col("hi")).withColumn("slab", F.when(F.col("lo") >= n, 1 << levels).otherwise(0).cast("long") + within)
    current = cut(both, "slabs")
    for shift in range(levels, 0, -1):
        after = cut(_contract(current, shift, n), "slabs")
        discard(current)
        current = after
    return current.groupBy("slab").applyInArrow(lambda key, t: _sweep(t), "a long, b long, c long")


def merge_tables(vertices: DataFrame, edges: DataFrame, slabs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(domain(key, v, f, rank), parents(rank, pj, ps), pairs(young, saddle, old, sweep)) in ranks; pj and ps null at roots. ``slabs``: of each tree, chosen by size if not given."""
    with temporary(vertices.sparkSession) as keep:
        own, links = ranked_domains(vertices, edges, keep)
        n = max(own.count(), 1)
        found = keep(swept(links, n, slabs), "swept")
    split = F.col("a") >= n
    back = lambda c: F.when(split, F.lit(2 * n - 1) - F.col(c)).otherwise(F.col(c))
    hung = found.filter("c IS NULL").select(back("a").alias("rank"), back("b").alias("p"), split.alias("split"))
    hung = hung.groupBy("rank").agg(F.max(F.when(~F.col("split"), F.col("p"))).alias("pj"), F.max(F.when(F.col("split"), F.col("p"))).alias("ps"))
    parents = own.select("key", "rank").join(hung, "rank", "left")
    pairs = found.filter("c IS NOT NULL").select(back("a").alias("young"), back("b").alias("saddle"), back("c").alias("old"), F.when(split, "up").otherwise("down").alias("sweep"))
    return own, parents, pairs


def merge_trees(vertices: DataFrame, edges: DataFrame, slabs: int | None = None) -> DataFrame:
    """key, tree ("join", "split"), v, parent (null at the root)."""
    own, parents, _ = merge_tables(vertices, edges, slabs)
    both = parents.select("rank", F.explode(F.array(F.struct(F.lit("join").alias("tree"), F.col("pj").alias("p")), F.struct(F.lit("split").alias("tree"), F.col("ps").alias("p")))).alias("t"))
    both = both.select("rank", "t.tree", "t.p").join(own.select("key", "rank", "v"), "rank")
    return both.join(own.select(F.col("rank").alias("p"), F.col("v").alias("parent")), "p", "left").select("key", "tree", "v", "parent")


def persistence(vertices: DataFrame, edges: DataFrame, slabs: int | None = None) -> DataFrame:
    """key, extremum, saddle, killed_by, persistence, sweep: the sweep "up" pairs minima, "down" maxima; the oldest of each component has no partner."""
    own, _, pairs = merge_tables(vertices, edges, slabs)
    return named_pairs(own, pairs)


def named_pairs(own: DataFrame, pairs: DataFrame) -> DataFrame:
    at = lambda c, *more: own.select(F.col("rank").alias(c), F.col("v").alias(f"v_{c}"), *more)
    out = pairs.join(at("young", "key", F.col("f").alias("fy")), "young").join(at("saddle", F.col("f").alias("fs")), "saddle").join(at("old"), "old")
    fall = F.abs(F.col("fy").cast("float") - F.col("fs").cast("float")).cast("double")
    return out.select("key", F.col("v_young").alias("extremum"), F.col("v_saddle").alias("saddle"), F.col("v_old").alias("killed_by"), fall.alias("persistence"), "sweep")
