"""Trees of a function on a graph, many projects at once.

Input of every operator: vertices(key, v, f) and edges(key, src, dst). Merge trees and persistence pairs are always made over tables (:mod:`merge`). Contour trees and what follows from them are made by the kernels, a task for each
domain, where every domain has at most ``DOMAIN_ROWS`` vertices and edges, and over tables (:mod:`contour`) where one is larger; results are the same. Views and landscapes take the critical
tree of a domain in one task. Results are tables keyed by the project.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import geometry, topology
from . import contour
from .common import cut
from .merge import merge_trees, persistence  # noqa: F401

#: Vertices and edges of a domain that one task may hold.
DOMAIN_ROWS = 1_000_000


def _sized(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges, written as they are counted and read again, and whether every domain fits a task."""
    edges = cut(edges.select("key", "src", "dst"), "edges")
    sizes = vertices.groupBy("key").count().unionByName(edges.groupBy("key").count()).groupBy("key").agg(F.sum("count").alias("n"))
    return edges, sizes.filter(F.col("n") > DOMAIN_ROWS).isEmpty()


def _per_domain(vertices: DataFrame, edges: DataFrame, kernel, columns: str) -> DataFrame:
    """kernel(domain) -> rows without the key, in vertex ids."""
    v = vertices.select("key", F.col("v").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("f").cast("double").alias("f"))
    e = edges.select("key", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(None).cast("double").alias("f"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["b"].isna()].drop_duplicates("a")
        pairs = rows[rows["b"].notna() & rows["a"].isin(own["a"]) & rows["b"].isin(own["a"])]
        d = topology.Domain(own["a"].to_numpy(), own["f"].to_numpy(), list(zip(pairs["a"], pairs["b"].astype("int64"), strict=True)))
        out = pd.DataFrame(list(kernel(d)), columns=names)
        out.insert(0, "key", key[0])
        return out

    return v.unionByName(e).groupBy("key").applyInPandas(run, f"key string, {columns}")


def _id(d, r):
    return int(d.ids[r]) if r >= 0 else None


def contour_arcs(vertices: DataFrame, edges: DataFrame, tau: float | None = None) -> DataFrame:
    """key, lo, hi: arcs of the augmented contour tree, simplified below tau if that is given."""
    edges, fits = _sized(vertices, edges)
    if not fits:
        return contour.contour_arcs(vertices, edges, tau)

    def kernel(d):
        tree = topology.build_tree(d) if tau is None else topology.simplify(d, tau)
        for lo, hi in tree.arcs():
            yield _id(d, lo), _id(d, hi)

    return _per_domain(vertices, edges, kernel, "lo long, hi long")


def tree_edges(vertices: DataFrame, edges: DataFrame, tau: float | None = None) -> DataFrame:
    """key, edge_id, n1 (lower), n2 (higher), members (both ends once): the edges of the critical tree, numbered by (lower, higher) in the total order.

    The members of an edge are one value here; :func:`member_rows` has them as rows.
    """
    edges, fits = _sized(vertices, edges)
    if not fits:
        tree, rows = contour.critical_tree(vertices, edges, tau)
        f = vertices.groupBy("key", "v").agg(F.min("f").alias("f"))
        own = rows.join(f, ["key", "v"]).groupBy("key", "edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda m: m["v"].cast("long")).alias("members"))
        return tree.join(own, ["key", "edge_id"])

    def kernel(d):
        tree = topology.build_tree(d) if tau is None else topology.simplify(d, tau)
        for i, (lo, hi, members) in enumerate(topology.contract(tree)):
            yield i, _id(d, lo), _id(d, hi), [_id(d, m) for m in members]

    return _per_domain(vertices, edges, kernel, "edge_id int, n1 long, n2 long, members array<long>")


def members(tree: DataFrame) -> DataFrame:
    """key, edge_id, v."""
    return tree.select("key", "edge_id", F.explode("members").alias("v"))


def member_rows(vertices: DataFrame, edges: DataFrame, tau: float | None = None) -> DataFrame:
    """key, edge_id, v: :func:`members` of :func:`tree_edges`, without an edge's members ever being one value where domains are large."""
    edges, fits = _sized(vertices, edges)
    return members(tree_edges(vertices, edges, tau)) if fits else contour.critical_tree(vertices, edges, tau)[1]


def containing_edge(member_rows: DataFrame, last: bool = False) -> DataFrame:
    """key, v, edge_id: of the edges that meet at a vertex the first, or the last."""
    pick = F.max if last else F.min
    return member_rows.groupBy("key", "v").agg(pick("edge_id").alias("edge_id"))


def degree_table(arcs: DataFrame) -> DataFrame:
    """key, v, up, down, node_class of the vertices of arcs(key, lo, hi)."""
    from .neighbours import node_class

    ends = arcs.select("key", F.col("lo").alias("v"), F.lit(1).alias("u"), F.lit(0).alias("d")).unionByName(arcs.select("key", F.col("hi").alias("v"), F.lit(0).alias("u"), F.lit(1).alias("d")))
    return ends.groupBy("key", "v").agg(F.sum("u").alias("up"), F.sum("d").alias("down")).withColumn("node_class", node_class(F.col("up"), F.col("down")))


def flattened_view(vertices: DataFrame, edges: DataFrame, tau: float) -> DataFrame:
    """key, n1, n2, flattened, level_vertex: which edges of the critical tree a view simplified below tau draws level, and with what."""

    def kernel(d):
        for lo, hi, flat, level in topology.flatten_view(d, tau):
            yield _id(d, lo), _id(d, hi), flat, _id(d, level)

    return _per_domain(vertices, edges, kernel, "n1 long, n2 long, flattened boolean, level_vertex long")


def region(tree: DataFrame, cut_vertex: int) -> DataFrame:
    """key, edge_id, visible: the part of the tree that stays with the cut vertex when its upward arcs are taken away.

    Components of the rest by the distributed labels of :mod:`neighbours`; keys are told apart inside the vertex.
    """
    from .neighbours import components

    tag = lambda c: F.struct("key", F.col(c).cast("long").alias("n"))
    rest = tree.filter(F.col("n1") != cut_vertex)
    ends = tree.select(tag("n1").alias("v")).unionByName(tree.select(tag("n2").alias("v"))).distinct()
    labels = components(ends, rest.select(tag("n1").alias("src"), tag("n2").alias("dst")))
    own = labels.filter(F.col("v.n") == cut_vertex).select("component")
    inside = labels.join(own, "component", "left_semi").select("v")
    seen = rest.withColumn("v", tag("n1")).join(inside, "v", "left_semi").select("key", "edge_id", F.lit(True).alias("_in"))
    return tree.join(seen, ["key", "edge_id"], "left").select("key", "edge_id", F.coalesce("_in", F.lit(False)).alias("visible"))


def _landscape_tables(vertices, edges, areas: DataFrame, tau, kernel, columns: str, tree: DataFrame | None = None) -> DataFrame:
    """Kernels that need the areas of tree edges: areas(key, edge_id, area). ``tree``: that of :func:`tree_edges`, if it is at hand."""
    tree = (tree_edges(vertices, edges, tau) if tree is None else tree).join(areas, ["key", "edge_id"]).select("key", "edge_id", "n1", "n2", "area")
    f = vertices.select("key", F.col("v").alias("n"), "f")
    tree = tree.join(f.withColumnRenamed("n", "n1").withColumnRenamed("f", "f1"), ["key", "n1"]).join(f.withColumnRenamed("n", "n2").withColumnRenamed("f", "f2"), ["key", "n2"])
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("edge_id")
        f = dict(zip(rows["n1"], rows["f1"], strict=True)) | dict(zip(rows["n2"], rows["f2"], strict=True))
        low, high = min(f.values()), max(f.values())
        top = min(v for v in f if f[v] == high)
        partition = topology.binary_space_partition(list(zip(rows["n1"], rows["n2"], strict=True)), top)
        area = rows["area"].to_numpy()
        total = topology.subtree_sums(partition, area)
        span = (high - low) or 1.0
        out = pd.DataFrame(list(kernel(partition, total, lambda v: 0.7 * (f[v] - low) / span, rows["edge_id"].tolist())), columns=names)
        out.insert(0, "key", key[0])
        return out

    return tree.groupBy("key").applyInPandas(run, f"key string, {columns}")


def space_partition(vertices, edges, areas, tau=None, tree=None) -> DataFrame:
    """key, edge_id, parent_edge, outer_v, inner_v, depth, sum_area: the tree's edges rooted at the highest vertex, with the areas of all below."""

    def kernel(partition, total, height, ids):
        for i, parent, outer, inner, depth in partition:
            yield ids[i], ids[parent] if parent >= 0 else None, outer, inner, depth, total[i]

    return _landscape_tables(vertices, edges, areas, tau, kernel, "edge_id int, parent_edge int, outer_v long, inner_v long, depth int, sum_area double", tree)


def floorplan(vertices, edges, areas, tau=None, tree=None) -> DataFrame:
    """key, edge_id, polygon: nested polygons of the unit square, areas in proportion to the areas of subtrees."""

    def kernel(partition, total, height, ids):
        for e, p in geometry.landscape(partition, total, height)[0]:
            yield ids[e], [{"x": float(x), "y": float(y)} for x, y in p]

    return _landscape_tables(vertices, edges, areas, tau, kernel, "edge_id int, polygon array<struct<x:double,y:double>>", tree)


def terrain(vertices, edges, areas, tau=None, tree=None) -> DataFrame:
    """key, edge_id, tri, corner, x, y, z, ct_node."""

    def kernel(partition, total, height, ids):
        for e, tri, corner, x, y, z, node in geometry.landscape(partition, total, height)[1]:
            yield ids[e], tri, corner, x, y, z, node

    return _landscape_tables(vertices, edges, areas, tau, kernel, "edge_id int, tri int, corner int, x double, y double, z double, ct_node long", tree)


def terrain_graph(triangles: DataFrame) -> DataFrame:
    """key, a, b, w: the sides of the triangles between distinct positions, weighted by their length; corners at one position are one vertex, named by it."""
    name = F.format_string("%.9f/%.9f/%.9f", "x", "y", "z")
    at = triangles.groupBy("key", "edge_id", "tri").agg(F.array_sort(F.collect_list(F.struct("corner", name.alias("p"), "x", "y", "z"))).alias("c"))
    sides = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(F.get("c", i).alias("p"), F.get("c", (i + 1) % 3).alias("q")))
    sides = at.select("key", F.explode(sides).alias("s")).filter("s.p.p <> s.q.p")
    length = F.sqrt(F.pow(F.col("s.p.x") - F.col("s.q.x"), 2) + F.pow(F.col("s.p.y") - F.col("s.q.y"), 2) + F.pow(F.col("s.p.z") - F.col("s.q.z"), 2))
    return sides.groupBy("key", F.least("s.p.p", "s.q.p").alias("a"), F.greatest("s.p.p", "s.q.p").alias("b")).agg(F.min(length).alias("w"))


def tree_layout(plan: DataFrame, partition: DataFrame, vertices: DataFrame) -> DataFrame:
    """key, edge_id, x, y, z in [0, 1]: the inner vertex of each edge, over the centroid of its polygon, at the height of its value."""
    from ..functions.columns import polygon_centroid
    from .statistics import normalised

    f = vertices.select("key", F.col("v").alias("inner_v"), F.col("f").cast("double").alias("y"))
    own = plan.filter(F.size("polygon") > 2).select("key", "edge_id", polygon_centroid(F.col("polygon"), "x").alias("x"), polygon_centroid(F.col("polygon"), "y").alias("z"))
    return normalised(own.join(partition.select("key", "edge_id", "inner_v"), ["key", "edge_id"]).join(f, ["key", "inner_v"]).select("key", "edge_id", "x", "y", "z"), ["x", "y", "z"])


def incident_edges(tree: DataFrame) -> DataFrame:
    """key, v, degree, edges (ascending): the edges of a tree(key, edge_id, n1, n2) at each of its vertices."""
    ends = tree.select("key", "edge_id", F.explode(F.array("n1", "n2")).alias("v"))
    return ends.groupBy("key", "v").agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("edge_id")).alias("edges"))


def not_reflexive(parents: DataFrame, children: DataFrame) -> DataFrame:
    """v, parent, lacks: links that only one of parents(v, parent) and children(parent, v) has. A sound tree gives no rows."""
    up, down = parents.filter("parent IS NOT NULL").select("v", "parent"), children.select("v", "parent")
    missing = lambda a, b, name: a.exceptAll(b).withColumn("lacks", F.lit(name))
    return missing(up, down, "child").unionByName(missing(down, up, "parent"))


def unexpressed(edges: DataFrame, laid_out: DataFrame) -> DataFrame:
    """The edges(key, edge_id) that a layout(key, edge_id) leaves out. A whole layout gives no rows."""
    return edges.select("key", "edge_id").exceptAll(laid_out.select("key", "edge_id").distinct())


def all_visible(tree: DataFrame) -> DataFrame:
    """key, edge_id, visible: the tree after its region is cleared."""
    return tree.select("key", "edge_id", F.lit(True).alias("visible"))


def terrain_positions(triangles: DataFrame) -> DataFrame:
    """key, v, positions: where each vertex of the tree stands on the terrain; corners without a vertex are left out."""
    own = triangles.filter("ct_node IS NOT NULL AND ct_node >= 0").groupBy("key", F.col("ct_node").alias("v"))
    return own.agg(F.sort_array(F.collect_set(F.struct("x", "y", "z"))).alias("positions"))
