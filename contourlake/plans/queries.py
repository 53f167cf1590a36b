"""The registered queries: operators applied to the tables, each with the SQL that an independent engine can run.

Stand-ins: a vector of ``embeddings`` is a structure and its point, its first component the function f, its second the colour function g, ``label`` a tree edge or group; a
structure's text is made of its components, three for each of 21 atoms; ``pages.url`` and ``documents.source`` are paths; ``conversations`` are chat logs; ``events``
are pushed rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colors, columns
from ..operators import linalg, neighbours, paths, statistics, topology
from ..operators.common import cut, numbered, shared_dir
from ..sources import codec, logs, structures
from ..streaming import refresh
from . import session, tree_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 10
TAU = 0.05


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("conf_id"), F.col("embedding").alias("v"))


def values(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.element_at("embedding", 1).alias("f"))


def knn(spark, d, k: int = K) -> DataFrame:
    return neighbours.nearest(points(spark, d), k)


def edges(spark, d) -> DataFrame:
    return neighbours.undirected(knn(spark, d))


def domain(spark, d) -> tuple[DataFrame, DataFrame]:
    """vertices(key, v, f), edges(key, src, dst) of one project."""
    return values(spark, d).withColumn("key", F.lit("all")), edges(spark, d).withColumn("key", F.lit("all"))


def six(c):
    return F.round(c, 6)


KNN_SQL = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(range(1, 65), lambda k: (a.v[k] - b.v[k]) * (a.v[k] - b.v[k]))) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank, d2 FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 10),
edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM knn),
adj AS (SELECT src AS v, dst AS w FROM edges UNION ALL SELECT dst, src FROM edges),
f AS (SELECT vec_id AS v, embedding[1] AS f FROM embeddings),
nb AS (SELECT adj.v, adj.w, a.f AS fv, b.f AS fw, (b.f > a.f OR (b.f = a.f AND adj.w > adj.v)) AS up FROM adj JOIN f a ON a.v = adj.v JOIN f b ON b.v = adj.w)"""


@query(f"WITH {KNN_SQL} SELECT src, dst, rank::INT AS rank, round(d2, 9) AS d2 FROM knn")
def knn_exact(spark, d):
    return knn(spark, d).select("src", "dst", "rank", F.round("d2", 9).alias("d2"))


@query(f"WITH {KNN_SQL} SELECT src, dst FROM edges")
def knn_edges(spark, d):
    return edges(spark, d)


@query(f"WITH {KNN_SQL} SELECT v, count(*) AS degree FROM adj GROUP BY v")
def knn_degree(spark, d):
    return neighbours.degrees(edges(spark, d))


@query(f"""WITH RECURSIVE {KNN_SQL}, reach(v, c) AS (SELECT v, v FROM f UNION SELECT adj.w, reach.c FROM reach JOIN adj ON adj.v = reach.v WHERE adj.w > reach.c),
low AS (SELECT v, min(c) AS component FROM reach GROUP BY v) SELECT component, count(*) AS n FROM low GROUP BY component""")
def knn_components(spark, d):
    return neighbours.components(values(spark, d).select("v"), edges(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(embedding[1]) AS min_f, max(embedding[1]) AS max_f, CASE WHEN max(embedding[1]) = min(embedding[1]) THEN 1.0 ELSE round((max(embedding[1]) - min(embedding[1]))::DOUBLE, 6) END AS range_f FROM embeddings")
def function_stats(spark, d):
    return statistics.function_range(values(spark, d)).withColumn("range_f", six(F.col("range_f").cast("double")))


HISTOGRAM = """WITH v AS ({values}), r AS (SELECT min(f) AS lo, CASE WHEN max(f) = min(f) THEN 1.0 ELSE max(f) - min(f) END AS span FROM v),
b AS (SELECT least(floor({factor}::DOUBLE * (f - lo) / span), {last})::INT AS bin, count(*) AS n FROM v, r GROUP BY 1),
shares AS (SELECT i::INT AS bin, coalesce(n, 0) / (SELECT sum(n) FROM b)::DOUBLE AS share FROM range({bins}) t(i) LEFT JOIN b ON b.bin = i)"""


@query(HISTOGRAM.format(values="SELECT embedding[1]::DOUBLE AS f FROM embeddings", factor=20, last=19, bins=20) + " SELECT bin, round(share, 9) AS share FROM shares")
def function_histogram(spark, d):
    return statistics.histogram(values(spark, d).select(F.col("f").cast("double").alias("f")), 20).select("bin", F.round("share", 9).alias("share"))


@query(
    tree_sql.pair_values(KNN_SQL) + ", " + HISTOGRAM.removeprefix("WITH ").format(values="SELECT f FROM pairs", factor=999, last=999, bins=1000)
    + ", k AS (SELECT a.bin, sum(0.75 * (1 - ((a.bin - b.bin) / 10.0::DOUBLE) * ((a.bin - b.bin) / 10.0::DOUBLE)) * b.share) AS s FROM shares a JOIN shares b ON abs(a.bin - b.bin) <= 10 GROUP BY 1) SELECT bin, round(s / (SELECT max(s) FROM k), 6) AS density FROM k"
)
def persist_kde(spark, d):
    gaps = cut(topology.persistence(*domain(spark, d)).select(F.col("persistence").alias("f")), "pairs")
    return statistics.density(statistics.histogram(gaps, 1000, closed=False)).select("bin", six(F.col("density")).alias("density"))


def _paths(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("conf_id"), F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".pdb")).alias("path"))


def _names(spark, d, flag):
    return _paths(spark, d).join(table(spark, d, "labels").filter(F.col(flag) == 1).select(F.col("doc_id").alias("conf_id")), "conf_id", "left_semi").select("path")


PATHS_SQL = "p AS (SELECT doc_id AS conf_id, source || '/doc' || doc_id || '.pdb' AS path FROM documents)"


@query(f"WITH {PATHS_SQL} SELECT (row_number() OVER (ORDER BY conf_id) - 1)::INT AS s_id, conf_id FROM p WHERE conf_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def whitelist_filter(spark, d):
    return neighbours.sample_map(_paths(spark, d), _names(spark, d, "quality"))


@query(f"WITH {PATHS_SQL} SELECT (row_number() OVER (ORDER BY conf_id) - 1)::INT AS s_id, conf_id FROM p WHERE conf_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blacklist_filter(spark, d):
    return neighbours.sample_map(_paths(spark, d), _names(spark, d, "toxic"), keep=False)


@query(r"SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https?://blog\.[a-z]+\.example\.(org|net)/en/[0-9]+.*')")
def regex_search(spark, d):
    return table(spark, d, "pages").filter(columns.full_match(F.col("url"), r"https?://blog\.[a-z]+\.example\.(org|net)/en/[0-9]+.*")).select("page_id", "url")


@query(f"WITH {PATHS_SQL}, s AS (SELECT row_number() OVER (ORDER BY conf_id) - 1 AS s_id, * FROM p WHERE conf_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT s_id::INT AS s_id, path FROM s WHERE regexp_full_match(path, 'src1[0-9]?/doc.*7[.]pdb')")
def regex_search_sampled(spark, d):
    found = _paths(spark, d).filter(columns.full_match(F.col("path"), "src1[0-9]?/doc.*7[.]pdb"))
    return found.join(whitelist_filter(spark, d), "conf_id").select("s_id", "path")


def _lines(spark, d) -> DataFrame:
    """conf_id, line_no, line: an N atom, 21 alpha carbons and an end for each vector."""
    e = table(spark, d, "embeddings")
    coordinate = lambda i, k: (F.element_at("embedding", (3 * i + k).cast("int")).cast("double") * 10).cast("double")
    atom = lambda i: F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f", i + 1, i + 1, coordinate(i, 1), coordinate(i, 2), coordinate(i, 3))
    atoms = F.transform(F.sequence(F.lit(0), F.lit(20)), atom)
    lines = F.concat(F.array(F.lit("ATOM      0  N   ALA A   1       0.000   0.000   0.000")), atoms, F.array(F.lit("HETATM   22  CA  CA  A  22       1.000   1.000   1.000"), F.lit("TER")))
    return e.select(F.col("vec_id").alias("conf_id"), F.posexplode(lines).alias("line_no", "line"))


ATOMS_SQL = """t AS (SELECT vec_id AS conf_id, i AS res_idx, printf('%8.3f', embedding[3*i+1]::DOUBLE * 10) AS tx, printf('%8.3f', embedding[3*i+2]::DOUBLE * 10) AS ty, printf('%8.3f', embedding[3*i+3]::DOUBLE * 10) AS tz
FROM embeddings, range(21) r(i)),
atoms AS (SELECT conf_id, res_idx::INT AS res_idx, trim(tx)::FLOAT AS x, trim(ty)::FLOAT AS y, trim(tz)::FLOAT AS z FROM t),
pairs AS (SELECT a.conf_id, a.res_idx AS i, b.res_idx AS j, (a.x::DOUBLE - b.x) * (a.x::DOUBLE - b.x) + (a.y::DOUBLE - b.y) * (a.y::DOUBLE - b.y) + (a.z::DOUBLE - b.z) * (a.z::DOUBLE - b.z) AS d2
FROM atoms a JOIN atoms b ON a.conf_id = b.conf_id AND a.res_idx < b.res_idx)"""


@query(f"WITH {ATOMS_SQL} SELECT conf_id, res_idx, x, y, z FROM atoms")
def pdb_parse(spark, d):
    return structures.backbone(_lines(spark, d))


@query("SELECT vec_id AS conf_id, 21 AS n_residues FROM embeddings")
def residue_count(spark, d):
    return structures.residue_counts(_lines(spark, d))


@query(f"WITH {ATOMS_SQL}, s AS (SELECT conf_id, i AS res_idx, sqrt(d2) AS d FROM pairs WHERE j = i + 1), m AS (SELECT conf_id, avg(d) AS m FROM s GROUP BY 1) SELECT conf_id, res_idx, round(d, 6) AS d, round(m, 6) AS mean_d, d < 3 * m AS drawn FROM s JOIN m USING (conf_id)")
def backbone_lengths(spark, d):
    return statistics.backbone_steps(pdb_parse(spark, d)).withColumns({"d": six(F.col("d")), "mean_d": six(F.col("mean_d"))})


@query(f"WITH {ATOMS_SQL} SELECT conf_id, count_if(d2 <= 9)::INT AS contacts FROM pairs GROUP BY 1")
def contact_density(spark, d):
    return statistics.contact_density(pdb_parse(spark, d), squared=9.0)


@query(f"WITH {ATOMS_SQL} SELECT conf_id, count_if(d2 <= 9 AND i IN (2, 3, 5, 8, 13) AND j IN (2, 3, 5, 8, 13))::INT AS contacts FROM pairs GROUP BY 1")
def contact_density_residues(spark, d):
    return statistics.contact_density(pdb_parse(spark, d), [2, 3, 5, 8, 13], squared=9.0)


def _backbones(spark, d):
    return pdb_parse(spark, d).groupBy("conf_id").agg(F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z"))).alias("b"))


_text = lambda v: F.array_join(F.transform(v, lambda x: F.format_string("%.4f", x)), " ")
_vector_sql = lambda where: f"WITH {ATOMS_SQL} SELECT conf_id, string_agg(printf('%.4f', sqrt(d2)), ' ' ORDER BY i, j) AS v FROM pairs WHERE {where} GROUP BY 1"


@query(_vector_sql("true"))
def pairwise_distance_vector(spark, d):
    return _backbones(spark, d).select("conf_id", _text(columns.pairwise_distances(F.col("b"))).alias("v"))


@query(_vector_sql("j - i <= 4"))
def banded_distance_vector(spark, d):
    return _backbones(spark, d).select("conf_id", _text(columns.pairwise_distances(F.col("b"), 4)).alias("v"))


@query(_vector_sql("i >= 8 AND j < 17"))
def region_distance_vector(spark, d):
    return _backbones(spark, d).select("conf_id", _text(columns.pairwise_distances(F.slice("b", 9, 9))).alias("v"))


def _groups(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("f"), F.element_at("embedding", 2).cast("double").alias("g"), F.col("embedding").alias("v"))


@query("WITH x AS (SELECT k AS pos, avg(embedding[k + 1]::DOUBLE) AS m FROM embeddings, range(64) r(k) GROUP BY 1) SELECT pos::INT AS pos, round(m, 9) AS m FROM x")
def mean_vector(spark, d):
    return statistics.mean_vector(points(spark, d)).select(F.posexplode("mean").alias("pos", "m")).select("pos", F.round("m", 9).alias("m"))


@query("""WITH m AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) r(k) GROUP BY 1, 2),
x AS (SELECT vec_id, e.label, sum((embedding[m.k]::DOUBLE - m.m) * (embedding[m.k]::DOUBLE - m.m)) AS d2 FROM embeddings e JOIN m ON m.label = e.label GROUP BY 1, 2)
SELECT label, round(CASE WHEN count(*) > 1 AND sum(sqrt(d2)) > 0 THEN sum(sqrt(d2)) / (count(*) - 1) ELSE 0.1 END, 6) AS area FROM x GROUP BY 1""")
def edge_area(spark, d):
    return statistics.spread(_groups(spark, d), "label").select("label", six(F.col("area")).alias("area"))


@query("""SELECT label, count(*) AS n, round(avg(embedding[2]::DOUBLE), 6) AS mean_g, round(stddev_pop(embedding[2]::DOUBLE), 6) AS stdev_g, round(CASE WHEN min(embedding[1]) = max(embedding[1]) OR min(embedding[2]) = max(embedding[2]) THEN 1 ELSE corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) END, 6) AS corr_fg FROM embeddings GROUP BY label""")
def edge_statistics(spark, d):
    return statistics.component_statistics(_groups(spark, d), "label").select("label", "n", *(six(F.col(c)).alias(c) for c in ("mean_g", "stdev_g", "corr_fg")))


@query("WITH c AS (SELECT label, count_if(vec_id BETWEEN 50 AND 249) AS n_inside FROM embeddings GROUP BY 1) SELECT label, n_inside::BIGINT AS n_inside, (min(n_inside) OVER ())::BIGINT AS min_count, (max(n_inside) OVER ())::BIGINT AS max_count FROM c")
def edge_roi_counts(spark, d):
    return statistics.region_counts(_groups(spark, d), "label", F.col("vec_id").between(50, 249))


@query("""WITH t AS (SELECT count_if(vec_id < 100) AS a, count_if(vec_id BETWEEN 100 AND 299) AS b, count_if(vec_id >= 300) AS c FROM embeddings),
x AS (SELECT label, count_if(vec_id < 100) / greatest(any_value(a), 1)::DOUBLE AS a, count_if(vec_id BETWEEN 100 AND 299) / greatest(any_value(b), 1)::DOUBLE AS b, count_if(vec_id >= 300) / greatest(any_value(c), 1)::DOUBLE AS c FROM embeddings, t GROUP BY 1)
SELECT label, round(a / (a + b + c), 6) AS share_1, round(b / (a + b + c), 6) AS share_2, round(c / (a + b + c), 6) AS share_3 FROM x""")
def group_composition(spark, d):
    i = F.col("vec_id")
    out = statistics.composition(_groups(spark, d), "label", [i < 100, i.between(100, 299), i >= 300])
    return out.select("label", *(six(F.col(f"share_{n}")).alias(f"share_{n}") for n in (1, 2, 3)))


@query("SELECT count(DISTINCT embedding[2]) = 2 AS is_binary FROM embeddings")
def binary_mode(spark, d):
    return statistics.is_binary(_groups(spark, d), "g")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS cx, round(avg(embedding[2]::DOUBLE), 6) AS cy, round(avg(embedding[3]::DOUBLE), 6) AS cz FROM embeddings GROUP BY label")
def selection_centroid(spark, d):
    return _groups(spark, d).groupBy("label").agg(*(six(F.avg(F.element_at("v", i + 1).cast("double"))).alias(c) for i, c in enumerate(("cx", "cy", "cz"))))


STEEP_SQL = "WITH {knn}, s AS (SELECT nb.v, nb.w, abs(fv::DOUBLE - fw::DOUBLE) / sqrt(d2) AS slope FROM nb JOIN d ON d.src = nb.v AND d.dst = nb.w WHERE {up}), b AS (SELECT v, max(struct_pack(slope := slope, w := w)) AS m FROM s GROUP BY v) SELECT f.v, coalesce(b.m.w, f.v) AS target FROM f LEFT JOIN b ON b.v = f.v"


def _steepest(spark, d, up):
    p = points(spark, d).select(F.col("conf_id").alias("i"), F.col("v").alias("p")).select(F.col("i").alias("v"), "p")
    return neighbours.steepest(edges(spark, d), values(spark, d), p, up)


@query(STEEP_SQL.format(knn=KNN_SQL, up="up"))
def steepest_ascent(spark, d):
    return _steepest(spark, d, True)


@query(STEEP_SQL.format(knn=KNN_SQL, up="NOT up"))
def steepest_descent(spark, d):
    return _steepest(spark, d, False)


@query(f"WITH {KNN_SQL}, c AS (SELECT v, count_if(up)::BIGINT AS up, count_if(NOT up)::BIGINT AS down FROM nb GROUP BY v) SELECT v, up, down, CASE WHEN up = 1 AND down = 1 THEN 'ordinary' WHEN up = 0 AND down = 1 THEN 'max' WHEN down = 0 AND up = 1 THEN 'min' WHEN up = 0 OR down = 0 THEN 'other' WHEN down = 1 THEN 'branch_up' WHEN up = 1 THEN 'branch_down' ELSE 'multibranch' END AS node_class FROM c")
def vertex_classes(spark, d):
    return neighbours.vertex_classes(edges(spark, d), values(spark, d))


@query("SELECT vec_id AS v, row_number() OVER (ORDER BY embedding[1], vec_id)::INT AS place FROM embeddings")
def vertex_order(spark, d):
    return numbered(values(spark, d), [F.col("f"), F.col("v")], "place", first=1).select("v", "place")


@query("WITH m AS (SELECT max(embedding[1]) AS f FROM embeddings) SELECT min(vec_id) AS v, any_value(f) AS f FROM embeddings, m WHERE embedding[1] = f")
def highest_vertex(spark, d):
    return values(spark, d).agg(F.max(F.struct("f", (-F.col("v")).alias("i"))).alias("m")).select((-F.col("m.i")).alias("v"), F.col("m.f").alias("f"))


_RANKS = "rk AS (SELECT v, f, (row_number() OVER (ORDER BY f, v))::BIGINT AS r FROM f)"
_LEVELS = f"{_RANKS}, {tree_sql.levels('', 'SELECT a.r AS a, b.r AS b FROM adj JOIN rk a ON a.v = adj.v JOIN rk b ON b.v = adj.w')}"
MERGE_SQL = f"""WITH RECURSIVE {KNN_SQL}, {_LEVELS}
SELECT 'all' AS key, 'join' AS tree, rk.v, coalesce(p.v, -1) AS parent FROM rk LEFT JOIN above ON above.l = rk.r LEFT JOIN rk p ON p.r = above.t
UNION ALL SELECT 'all', 'split', rk.v, coalesce(p.v, -1) FROM rk LEFT JOIN below ON below.l = rk.r LEFT JOIN rk p ON p.r = below.t"""
PAIRS_SQL = f"""WITH RECURSIVE {KNN_SQL}, {_LEVELS}, {tree_sql.falls('')}
SELECT 'all' AS key, y.v AS extremum, s.v AS saddle, o.v AS killed_by, abs(y.f - s.f)::DOUBLE AS persistence, sweep
FROM falls JOIN rk y ON y.r = young JOIN rk s ON s.r = t JOIN rk o ON o.r = old WHERE old IS NOT NULL"""


@query(MERGE_SQL)
def merge_trees(spark, d):
    return topology.merge_trees(*domain(spark, d)).withColumn("parent", F.coalesce("parent", F.lit(-1)))


@query(PAIRS_SQL)
def persistence_pairs(spark, d):
    return topology.persistence(*domain(spark, d))


@query(tree_sql.contour_tree(KNN_SQL))
def contour_tree(spark, d):
    return topology.contour_arcs(*domain(spark, d))


def _members_as_text(tree: DataFrame) -> DataFrame:
    return tree.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query(tree_sql.critical_tree(KNN_SQL))
def contracted_tree(spark, d):
    return _members_as_text(topology.tree_edges(*domain(spark, d)))


@query(tree_sql.critical_tree(KNN_SQL, TAU))
def simplified_tree(spark, d):
    return _members_as_text(topology.tree_edges(*domain(spark, d), tau=TAU))


@query(tree_sql.node_classes(KNN_SQL))
def tree_node_classes(spark, d):
    return topology.degree_table(topology.contour_arcs(*domain(spark, d)))


@query(tree_sql.members(KNN_SQL, TAU) + " SELECT 'all' AS key, edge_id, v FROM inside")
def component_members(spark, d):
    return topology.member_rows(*domain(spark, d), tau=TAU)


@query(tree_sql.members(KNN_SQL, TAU) + " SELECT 'all' AS key, v, min(edge_id) AS edge_id, max(edge_id) AS last_edge_id FROM inside GROUP BY v")
def vertex_edge(spark, d):
    m = cut(component_members(spark, d), "members")
    return topology.containing_edge(m).join(topology.containing_edge(m, last=True).withColumnRenamed("edge_id", "last_edge_id"), ["key", "v"])


@query(tree_sql.members(KNN_SQL, TAU) + """ SELECT edge_id, count(*) AS n, round(avg(embedding[2]::DOUBLE), 6) AS mean_g, round(stddev_pop(embedding[2]::DOUBLE), 6) AS stdev_g,
round(CASE WHEN min(embedding[1]) = max(embedding[1]) OR min(embedding[2]) = max(embedding[2]) THEN 1 ELSE corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) END, 6) AS corr_fg FROM inside JOIN embeddings ON vec_id = inside.v GROUP BY edge_id""")
def component_statistics(spark, d):
    m = component_members(spark, d)
    g = _groups(spark, d).select(F.col("vec_id").alias("i"), "f", "g")
    out = statistics.component_statistics(m.join(g, m.v == g.i).select("edge_id", "f", "g"), "edge_id")
    return out.select("edge_id", "n", *(six(F.col(c)).alias(c) for c in ("mean_g", "stdev_g", "corr_fg")))


@query()
def flattened_view(spark, d):
    return topology.flattened_view(*domain(spark, d), TAU)


@query(tree_sql.trees(KNN_SQL, TAU) + """, spot AS (SELECT arg_max(n1, struct_pack(m := len(members), v := a.v)) AS c FROM crit JOIN rk a ON a.r = n1),
rest AS (SELECT n1, n2, edge_id FROM crit, spot WHERE n1 <> c), inside(v) AS (SELECT c FROM spot UNION SELECT CASE WHEN n1 = inside.v THEN n2 ELSE n1 END FROM inside JOIN rest ON inside.v IN (n1, n2))
SELECT 'all' AS key, edge_id, coalesce(n1 <> c AND n1 IN (SELECT v FROM inside), false) AS visible FROM crit, spot""")
def roi_cut(spark, d):
    tree = cut(topology.tree_edges(*domain(spark, d), tau=TAU), "tree")
    cut_at = tree.agg(F.max_by("n1", F.struct(F.size("members"), "n1"))).first()[0]
    return topology.region(tree, cut_at if cut_at is not None else -1)


WEIGHTED_SQL = KNN_SQL + """, near AS (SELECT adj.v, adj.w, sqrt(d.d2) AS c FROM adj JOIN d ON d.src = least(adj.v, adj.w) AND d.dst = greatest(adj.v, adj.w))"""
# Each round replaces a vertex's cost where a cheaper way in was found; it ends when none was.
_COSTS = """costs(v, cost) USING KEY (v) AS (SELECT v::BIGINT, 0.0::DOUBLE FROM (VALUES {starts}) t(v) UNION
SELECT near.w, min(x.cost + {step}) FROM costs x JOIN near ON near.v = x.v LEFT JOIN recurring.costs y ON y.v = near.w WHERE y.cost IS NULL OR x.cost + {step} < y.cost GROUP BY near.w)"""
COSTS_SQL = "WITH RECURSIVE " + WEIGHTED_SQL + ", " + _COSTS.format(starts="(0)", step="near.c") + " SELECT v, round(cost, 6) AS cost FROM costs"
HOPS_SQL = "WITH RECURSIVE " + WEIGHTED_SQL + ", " + _COSTS.format(starts="(0)", step="1.0") + " SELECT v, cost FROM costs"
# Back from the cheapest end, each time to the neighbour whose cost and step make up the vertex's own; of several the least in (cost, vertex).
PATH_SQL = "WITH RECURSIVE " + WEIGHTED_SQL + ", " + _COSTS.format(starts="{starts}", step="near.c") + """,
goal AS (SELECT v, cost FROM costs WHERE v IN ({ends}) ORDER BY cost, v LIMIT 1),
back(v, n) AS (SELECT v, 0 FROM goal UNION ALL
  SELECT (SELECT min(struct_pack(cost := a.cost, v := a.v)).v FROM near JOIN costs a ON a.v = near.w JOIN costs own ON own.v = back.v WHERE near.v = back.v AND a.cost + near.c = own.cost), back.n + 1
  FROM back JOIN costs o ON o.v = back.v WHERE o.cost > 0)
SELECT 'all' AS key, (max(n) OVER () - n)::INT AS step, v, round((SELECT cost FROM goal), 6) AS cost FROM back"""


def _weighted(spark, d):
    p = points(spark, d).select(F.col("conf_id").alias("i"), F.col("v").alias("p")).select(F.col("i").alias("v"), "p")
    return paths.weighted_edges(edges(spark, d), p)


@query(PATH_SQL.format(starts="(0)", ends="0 + 1"))
def shortest_path_weighted(spark, d):
    return paths.shortest_path(_weighted(spark, d).withColumn("key", F.lit("all")), [0], [1]).withColumn("cost", six(F.col("cost")))


@query(PATH_SQL.format(starts="(0), (2)", ends="1, 3"))
def shortest_path_multi(spark, d):
    return paths.shortest_path(_weighted(spark, d).withColumn("key", F.lit("all")), [0, 2], [1, 3]).withColumn("cost", six(F.col("cost")))


@query(HOPS_SQL)
def hop_distances(spark, d):
    return paths.path_costs(edges(spark, d).withColumn("w", F.lit(1.0)), 0)


@query(COSTS_SQL)
def path_costs(spark, d):
    return paths.path_costs(_weighted(spark, d), 0).withColumn("cost", six(F.col("cost")))


HOP_PATH_SQL = PATH_SQL.replace("x.cost + near.c", "x.cost + 1.0").replace("a.cost + near.c = own.cost", "a.cost + 1.0 = own.cost")


@query(f"SELECT step, v FROM ({PATH_SQL.format(starts='(0)', ends='0 + 1')}) WHERE v IN (SELECT v FROM ({HOP_PATH_SQL.format(starts='(0)', ends='0 + 1')}))")
def path_intersection(spark, d):
    w = cut(_weighted(spark, d).withColumn("key", F.lit("all")), "weighted")
    return paths.common_steps(paths.shortest_path(w, [0], [1]), paths.shortest_path(w.withColumn("w", F.lit(1.0)), [0], [1]))


@query()
def pca_projection(spark, d):
    out = linalg.point_cloud(points(spark, d), components=8)
    return out.select("conf_id", F.transform("v", lambda x: F.round(x.cast("double"), 3)).alias("v"))


@query("SELECT round(sum(s), 4) AS total FROM (SELECT var_samp(embedding[k]::DOUBLE) AS s FROM embeddings, range(1, 65) r(k) GROUP BY k)")
def pca_variance(spark, d):
    return linalg.total_variance(points(spark, d)).select(F.round("total", 4).alias("total"))


@query()
def procrustes_rmsd(spark, d):
    shapes = _backbones(spark, d).select("conf_id", F.transform("b", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"), p["z"].cast("double"))).alias("xyz"))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("conf_id"), "label")
    return linalg.alignment(shapes.join(labels, "conf_id"), "label").withColumn("rmsd", six(F.col("rmsd")))


@query()
def graph_spectrum(spark, d):
    out = linalg.graph_eigenvalues(edges(spark, d), 6).withColumn("value", six(F.col("value")))
    return out.select(F.lit("all").alias("key"), "rank", "value")


def _landscape(spark, d):
    """vertices, edges, areas, tau, tree for the layouts; neighbours and tree are computed once."""
    vertices, own = domain(spark, d)
    tree = cut(topology.tree_edges(vertices, own, tau=TAU), "tree")
    p = points(spark, d)
    rows = topology.members(tree).withColumnRenamed("v", "i").join(p, F.col("i") == p.conf_id).select("edge_id", "v")
    areas = cut(statistics.spread(rows, "edge_id").withColumn("key", F.lit("all")), "areas")
    return vertices, own, areas, TAU, tree


@query(tree_sql.members(KNN_SQL, TAU) + """, own AS (SELECT edge_id, embedding FROM inside JOIN embeddings ON vec_id = inside.v),
m AS (SELECT edge_id, k, avg(embedding[k]::DOUBLE) AS m FROM own, range(1, 65) r(k) GROUP BY 1, 2),
x AS (SELECT inside.v, m.edge_id, sum((embedding[m.k]::DOUBLE - m.m) * (embedding[m.k]::DOUBLE - m.m)) AS d2 FROM inside JOIN embeddings ON vec_id = inside.v JOIN m ON m.edge_id = inside.edge_id GROUP BY 1, 2)
SELECT 'all' AS key, edge_id, round(CASE WHEN count(*) > 1 AND sum(sqrt(d2)) > 0 THEN sum(sqrt(d2)) / (count(*) - 1) ELSE 0.1 END, 6) AS area FROM x GROUP BY edge_id""")
def tree_edge_areas(spark, d):
    return _landscape(spark, d)[2].withColumn("area", six(F.col("area")))


@query()
def bsp_subtree_area(spark, d):
    return topology.space_partition(*_landscape(spark, d)).withColumn("sum_area", six(F.col("sum_area")))


@query()
def floorplan_polygons(spark, d):
    return topology.floorplan(*_landscape(spark, d))


@query()
def terrain_triangles(spark, d):
    return topology.terrain(*_landscape(spark, d))


@query()
def terrain_graph(spark, d):
    return topology.terrain_graph(cut(terrain_triangles(spark, d), "terrain"))


def _shade(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("f"))
    low_high = e.agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    return e.crossJoin(F.broadcast(low_high)).select("vec_id", colors.unit(F.col("f"), F.col("lo"), F.col("hi")).alias("s"))  # one row


def _diverging_sql(s: str, source: str) -> str:
    """CTEs ending in ``rgb`` (the rows of ``source`` with r, g, b) for values ``s`` in [0, 1]: through white between the two ends, in polar Lab."""
    (m1, s1, h1), (m2, s2, h2) = (colors.lab_to_msh(colors.rgb_to_lab(c)) for c in (colors.BLUE, colors.RED))
    white = max(m1, m2, 88.0)

    def side(m, sat, hue):
        # The hue of white next to a saturated end.
        turn = sat * math.sqrt(white * white - m * m) / (m * math.sin(sat)) if m < white - 0.1 else 0.0
        return hue + turn if hue > -0.3 * math.pi else hue - turn

    g1, g2 = side(m1, s1, h1), side(m2, s2, h2)
    way = lambda a, b: f"CASE WHEN s < 0.5 THEN {a[0]!r}::DOUBLE + ({a[1]!r}::DOUBLE - {a[0]!r}::DOUBLE) * (2 * s) ELSE {b[0]!r}::DOUBLE + ({b[1]!r}::DOUBLE - {b[0]!r}::DOUBLE) * (2 * s - 1) END"
    cube = lambda t: f"(CASE WHEN {t} * {t} * {t} > 0.008856 THEN {t} * {t} * {t} ELSE ({t} - 16.0::DOUBLE / 116) / 7.787 END)"
    gamma = lambda c: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {c} > 0.0031308 THEN 1.055 * pow(greatest({c}, 0.0::DOUBLE), 1 / 2.4::DOUBLE) - 0.055 ELSE 12.92 * {c} END))"
    row = lambda r: " + ".join(f"({c!r}::DOUBLE) * {k}" for c, k in zip(r, ("cx", "cy", "cz"), strict=True))
    return f"""v0 AS (SELECT *, ({s})::DOUBLE AS s FROM {source}),
v1 AS (SELECT *, {way((m1, white), (white, m2))} AS m, {way((s1, 0.0), (0.0, s2))} AS sat, {way((h1, g1), (g2, h2))} AS hue FROM v0),
v2 AS (SELECT *, (m * cos(sat) + 16) / 116 AS fy FROM v1),
v3 AS (SELECT *, m * sin(sat) * cos(hue) / 500 + fy AS fx, fy - m * sin(sat) * sin(hue) / 200 AS fz FROM v2),
v4 AS (SELECT *, {cube("fx")} * {colors.WHITE[0]!r} AS cx, {cube("fy")} * {colors.WHITE[1]!r} AS cy, {cube("fz")} * {colors.WHITE[2]!r} AS cz FROM v3),
v5 AS (SELECT *, {row(colors.XYZ_TO_RGB[0])} AS lr, {row(colors.XYZ_TO_RGB[1])} AS lg, {row(colors.XYZ_TO_RGB[2])} AS lb FROM v4),
rgb AS (SELECT *, {gamma("lr")} AS r, {gamma("lg")} AS g, {gamma("lb")} AS b FROM v5)"""


DIVERGING_SQL = "WITH s AS (SELECT vec_id, (embedding[1]::DOUBLE - min(embedding[1]) OVER ()::DOUBLE) / (max(embedding[1]) OVER ()::DOUBLE - min(embedding[1]) OVER ()::DOUBLE) AS share FROM embeddings), " + _diverging_sql("share", "s") + " SELECT vec_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM rgb"


def _channels(rows, key, c):
    """key, r, g, b of a colour column, computed once."""
    names = "rgb"
    return rows.select(key, F.inline(F.array(colors.let(c, lambda x: F.struct(*(six(x[k]).alias(k) for k in names))))))


SHADE_SQL = "s AS (SELECT vec_id, (embedding[1]::DOUBLE - min(embedding[1]) OVER ()::DOUBLE) / (max(embedding[1]) OVER ()::DOUBLE - min(embedding[1]) OVER ()::DOUBLE) AS s FROM embeddings)"
_clamp = lambda x: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 6)"


@query(f"WITH {SHADE_SQL} SELECT vec_id, {_clamp('1.5 - abs(4 * s - 3)')} AS r, {_clamp('1.5 - abs(4 * s - 2)')} AS g, {_clamp('1.5 - abs(4 * s - 1)')} AS b FROM s")
def jet_color(spark, d):
    return _channels(_shade(spark, d), "vec_id", colors.jet(F.col("s")))


@query(f"WITH {SHADE_SQL} SELECT vec_id, {_clamp('s')} AS r, {_clamp('s')} AS g, {_clamp('s')} AS b FROM s")
def gray_color(spark, d):
    return _channels(_shade(spark, d), "vec_id", colors.gray(F.col("s")))


@query(DIVERGING_SQL)
def diverging_color(spark, d):
    return _channels(_shade(spark, d), "vec_id", colors.diverging(F.col("s")))


@query()
def region_colors(spark, d):
    counts = edge_roi_counts(spark, d)
    c = colors.region_color(F.col("n_inside"), F.col("min_count"), F.col("max_count"))
    return counts.select("label", F.inline(F.array(c))).withColumns({k: six(F.col(k)) for k in "rgb"})


@query()
def component_colors(spark, d):
    """Mean, deviation and local correlation of g for each component, as diverging colours over their ranges."""
    s = cut(edge_statistics(spark, d), "statistics")
    limits = s.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("mean_g", "stdev_g", "corr_fg") for f in (F.min, F.max)))
    s = s.crossJoin(F.broadcast(limits))  # one row
    for c in ("mean_g", "stdev_g", "corr_fg"):
        s = s.withColumn(f"{c}_color", colors.diverging(colors.unit(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}"))))
    text = lambda c: colors.let(c, lambda x: F.format_string("%.5f %.5f %.5f", x["r"], x["g"], x["b"]))
    return s.select("label", *(text(F.col(f"{c}_color")).alias(f"{c}_color") for c in ("mean_g", "stdev_g", "corr_fg")))


@query("SELECT vec_id, CASE WHEN label = 1 THEN 1.0 WHEN label = 2 THEN 0.0 ELSE 0.5 END AS r, CASE WHEN label = 2 THEN 1.0 WHEN label = 1 THEN 0.0 ELSE 0.5 END AS g FROM embeddings")
def point_colors(spark, d):
    """The colour of the selection that a vertex's component has, grey without one."""
    picks = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (1, 3, 2)], "edge_id int, group_id int, at int")
    own = session.selected(picks)
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("edge_id")).join(F.broadcast(own), "edge_id", "left")
    pick = lambda yes, no: F.when(F.col("group_id") == yes, 1.0).when(F.col("group_id") == no, 0.0).otherwise(0.5)
    return rows.select("vec_id", pick(1, 2).alias("r"), pick(2, 1).alias("g"))


@query("SELECT vec_id AS v FROM embeddings WHERE label IN (1, 3)")
def selected_vertices(spark, d):
    m = table(spark, d, "embeddings").select(F.col("label").alias("edge_id"), F.col("vec_id").alias("v"))
    return session.selected_vertices(m, spark.createDataFrame([(1,), (3,), (1,)], "edge_id int"))


@query("""SELECT conv_id, count(*) AS n, string_agg('[' || turn || '] ' || role || ' > ' || text, chr(10) ORDER BY turn, '[' || turn || '] ' || role || ' > ' || text) AS lines FROM conversations GROUP BY conv_id""")
def chat_log(spark, d):
    line = logs.chat_line(F.col("turn").cast("string"), F.col("role"), F.col("text"))
    return refresh.history(table(spark, d, "conversations"), ["conv_id"], ["turn"], line)


def _annotations(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.col("role").alias("name"), F.col("turn").cast("int").alias("s_id"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("ts"))


@query("SELECT role AS name, turn::INT AS s_id, 't' || conv_id AS ts FROM conversations WHERE NOT (conv_id % 3 = 0)")
def annotation_merge(spark, d):
    every = _annotations(spark, d)
    local = every.filter(F.substring("ts", 2, 20).cast("long") % 3 == 0)
    return session.missing_annotations(every, local).select("name", "s_id", "ts")


@query("SELECT 'board' || (conv_id % 5) AS board, count(*) AS n, max(turn)::INT AS last FROM conversations GROUP BY 1")
def storyboard_resolve(spark, d):
    every = _annotations(spark, d).distinct()
    boards = every.groupBy(F.concat(F.lit("board"), (F.substring("ts", 2, 20).cast("long") % 5).cast("string")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("name", "s_id", "ts"))).alias("annotations"))
    return session.resolve_storyboards(boards, every).groupBy("board").agg(F.count(F.lit(1)).alias("n"), F.max("s_id").alias("last"))


@query("SELECT DISTINCT c_name AS \"user\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def username_available(spark, d):
    c = table(spark, d, "customer")
    busy = c.join(table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_name").alias("user"))
    return session.name_is_free(busy, c.select(F.col("c_name").alias("user")).distinct())


@query("SELECT e.event_id, c.c_name AS \"user\" FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def push_targets(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("project"))
    users = table(spark, d, "customer").select(F.col("c_name").alias("user"), F.col("c_custkey").alias("project"))
    return session.push_targets(rows, users, ["project"]).select("event_id", "user")


@query("SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN '.TXT' ELSE '.txt' END, '\\.txt$', '', 'i') AS name FROM part")
def menu_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", columns.menu_name(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".TXT").otherwise(".txt"))).alias("name"))


@query("WITH p AS (SELECT source || '/' AS parent, source || '/doc' || doc_id || '.pdb' AS path FROM documents), r AS (SELECT parent, (row_number() OVER (PARTITION BY parent ORDER BY path) - 1) // 30 AS chunk FROM p) SELECT parent, chunk::INT AS chunk, count(*) AS members FROM r GROUP BY 1, 2")
def menu_groups(spark, d):
    return statistics.grouped_names(_paths(spark, d))


@query("""WITH n AS (SELECT DISTINCT source AS name FROM documents) SELECT name, row_number() OVER (ORDER BY regexp_replace(name, '[0-9]+$', ''), regexp_extract(name, '[0-9]+$')::INT)::INT AS place FROM n""")
def natural_sort(spark, d):
    n = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return n.select("name", F.row_number().over(Window.orderBy(columns.natural_key(F.col("name")))).alias("place"))  # one row for each source


@query("SELECT l_returnflag, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 'helix' WHEN 'N' THEN 'sheet' ELSE 'coil' END AS structure FROM lineitem GROUP BY 1")
def label_classes(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("structure", columns.structure_class(F.col("l_returnflag"), {"A": "helix", "N": "sheet", "X": "coil"}))


@query("WITH m AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b, min(s_suppkey) AS c, max(s_suppkey) AS e FROM supplier) SELECT s_suppkey AS id, round((s_acctbal - a) / (b - a), 6) AS x, round((s_suppkey - c) / (e - c)::DOUBLE, 6) AS y FROM supplier, m")
def normalised_positions(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    return statistics.normalised(rows, ["x", "y"]).withColumns({"x": six(F.col("x")), "y": six(F.col("y"))})


@query("SELECT c_custkey AS id, round((c_acctbal - 1000.0::DOUBLE) * (c_acctbal - 1000.0::DOUBLE) + (c_nationkey - 7.0::DOUBLE) * (c_nationkey - 7.0::DOUBLE), 6) AS d2 FROM customer ORDER BY d2, id LIMIT 1")
def nearest_point(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return statistics.nearest_to(rows, "id", 1000.0, 7.0).withColumn("d2", six(F.col("d2")))


@query("SELECT a, b FROM (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL")
def coincident_pairs(spark, d):
    return statistics.coincident_pairs(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"])


def _square(area_from):
    corner = lambda x, y: F.struct((x * area_from).cast("double").alias("x"), (y * area_from).cast("double").alias("y"))
    return F.array(corner(F.lit(0), F.lit(0)), corner(F.lit(2), F.lit(0)), corner(F.lit(2), F.lit(1)), corner(F.lit(0), F.lit(1)))


@query("SELECT p_partkey, (2 * p_size * p_size)::DOUBLE AS area, p_size::DOUBLE AS cx, p_size / 2.0::DOUBLE AS cy FROM part")
def polygon_measures(spark, d):
    p = table(spark, d, "part").withColumn("polygon", _square(F.col("p_size")))
    return p.select("p_partkey", columns.polygon_area(F.col("polygon")).alias("area"), F.round(columns.polygon_centroid(F.col("polygon"), "x"), 9).alias("cx"), F.round(columns.polygon_centroid(F.col("polygon"), "y"), 9).alias("cy"))


ENGINEERING_SQL = """WITH x AS (SELECT s_suppkey, s_acctbal::DOUBLE AS v FROM supplier),
e AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log10(abs(v)))::INT - 1 END AS e FROM x),
m AS (SELECT *, round_even(CASE WHEN v = 0 THEN 0 ELSE abs(v) / pow(10.0::DOUBLE, e) END, 2) AS m FROM e)
SELECT s_suppkey, CASE WHEN v < 0 THEN '-' ELSE '' END || printf('%05.2f', CASE WHEN m >= 100 THEN m / 10 ELSE m END) || 'E' || (CASE WHEN m >= 100 THEN e + 1 ELSE e END) AS text FROM m"""


@query(ENGINEERING_SQL)
def engineering_format(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", columns.scientific(F.col("s_acctbal")).alias("text"))


@query("SELECT user_id, count(*) AS n, string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS lines FROM events GROUP BY user_id")
def stream_refresh(spark, d):
    """The events as a file stream, pushed to one session a user, and replayed by user."""
    import uuid

    place = f"{shared_dir(spark)}/contourlake/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", "ts", "user_id", "event_type").write.parquet(f"{place}/log")
    stream = refresh.stream_log(spark, f"{place}/log", "event_id long, ts timestamp, user_id long, event_type string")
    sessions = table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), "user_id")
    refresh.fan_out(stream, sessions, f"{place}/state", f"{place}/checkpoint", ["user_id"]).awaitTermination()
    told = spark.read.parquet(f"{place}/state")
    line = F.concat_ws(":", F.col("event_id").cast("string"), "event_type")
    return refresh.history(told, ["user_id"], ["ts", "event_id"], line).withColumn("lines", F.replace("lines", F.lit("\n"), F.lit(",")))


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """An extra: tumbling windows over the event table, as the stream form counts them."""
    counts = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber BETWEEN s_nationkey % 5 AND s_nationkey % 5 + 1 OR l_linenumber = 7 AND s_nationkey = 3")
def region_steps(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("lo"), (F.col("s_nationkey") % 5 + 1).alias("hi"), "s_nationkey")
    ranges = s.drop("s_nationkey").unionByName(s.filter("s_nationkey = 3").select("l_suppkey", F.lit(7).alias("lo"), F.lit(7).alias("hi")))
    return statistics.in_ranges(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ranges, "l_suppkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_retailprice >= 1000 AND p_retailprice < 1200")
def stratum(spark, d):
    inside = statistics.strata(table(spark, d, "part"), "p_retailprice", 1000.0, 1200.0)
    return inside.agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def row_codec(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return codec.decode_rows(codec.encode_rows(rows, "chat"), "chat", rows.schema)


@query("SELECT p_partkey, round(p_size + (50 - p_size) * CASE WHEN p_size = 50 THEN 0 ELSE (25.0::DOUBLE - p_size) / (50 - p_size) END, 9) AS value, round(CASE WHEN p_size = 50 THEN 0 ELSE (25.0::DOUBLE - p_size) / (50 - p_size) END, 9) AS share FROM part")
def edge_interpolation(spark, d):
    size, top = F.col("p_size").cast("double"), F.lit(50.0)
    share = columns.level_share(F.lit(25.0), size, top)
    return table(spark, d, "part").select("p_partkey", F.round(columns.interpolate(size, top, share), 9).alias("value"), F.round(share, 9).alias("share"))


@query()
def tree_layout(spark, d):
    parts = _landscape(spark, d)
    return topology.tree_layout(topology.floorplan(*parts), topology.space_partition(*parts), parts[0])


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: exact neighbours, their graph, and each component's statistics of f."""
    own = cut(edges(spark, d), "edges")
    labels = neighbours.components(values(spark, d).select("v"), own)
    degree = neighbours.degrees(own)
    rows = labels.join(degree, "v", "left").join(values(spark, d), "v")
    return rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("degree").alias("degrees"), F.round(F.avg("f"), 6).alias("mean_f"), F.min("f").alias("min_f"), F.max("f").alias("max_f")
    )


from . import more_queries  # noqa: E402, F401  registers itself
