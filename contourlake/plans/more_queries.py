"""Further registered queries: checks, selections, sessions, sources, geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import colors, columns
from ..operators import neighbours, paths, statistics, topology
from ..operators.common import cut, numbered, shared_dir
from ..sources import codec, files
from . import session, tree_sql
from .queries import KNN_SQL, TAU, _landscape, domain, edges, points, query, six, table, values


def _members(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("edge_id"), F.col("vec_id").alias("v"))


@query("SELECT vec_id AS s_id, embedding[1] AS f, (row_number() OVER (ORDER BY embedding[1] DESC, vec_id) - 1)::INT AS place FROM embeddings WHERE label IN (1, 3)")
def selection_by_function(spark, d):
    picks = spark.createDataFrame([(1,), (3,)], "edge_id int")
    return session.selected_by_function(_members(spark, d), picks, values(spark, d).withColumnRenamed("v", "s_id"))


@query("SELECT DISTINCT label AS edge_id, 0 AS group_id FROM embeddings")
def cleared_selection(spark, d):
    return session.clear_selection(_members(spark, d))


@query("SELECT user_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def disconnected_sessions(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("user"), "event_type")
    gone = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("user"))
    return session.disconnect(users, gone).withColumnRenamed("user", "user_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
SELECT user_id, count(*) AS total, count_if(event_type = 'purchase') AS completed, round(count_if(event_type = 'purchase') / count(*)::DOUBLE, 9) AS share,
string_agg(CASE WHEN place <= 3 THEN event_type END, ',' ORDER BY place DESC) AS messages FROM r GROUP BY user_id""")
def task_progress(spark, d):
    out = statistics.progress(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", ["ts", "event_id"], "event_type", 3)
    return out.select("user_id", "total", "completed", F.round("share", 9).alias("share"), F.array_join("messages", ",").alias("messages"))


@query(tree_sql.merge_tree(KNN_SQL) + """, up AS (SELECT * FROM tree WHERE parent IS NOT NULL), down AS (SELECT * FROM up WHERE v % 7 <> 0 UNION ALL SELECT v, v FROM up WHERE v % 11 = 0)
SELECT v, parent, 'child' AS lacks FROM (SELECT v, parent FROM up EXCEPT ALL SELECT v, parent FROM down) UNION ALL SELECT v, parent, 'parent' FROM (SELECT v, parent FROM down EXCEPT ALL SELECT v, parent FROM up)""")
def reflexivity_check(spark, d):
    """The join tree's links against the same from the parents' side, of which some are taken out and some are made up."""
    up = cut(topology.merge_trees(*domain(spark, d)).filter("tree = 'join' AND parent IS NOT NULL").select("v", "parent"), "links")
    down = up.filter("v % 7 <> 0").unionByName(up.filter("v % 11 = 0").select("v", F.col("v").alias("parent")))
    return topology.not_reflexive(up, down)


@query(tree_sql.trees(KNN_SQL, TAU) + " SELECT 'all' AS key, edge_id FROM crit WHERE edge_id % 3 = 1")
def unexpressed_edges(spark, d):
    """The edges of a tree that a floor plan lacks, of which every third polygon is taken out."""
    parts = _landscape(spark, d)
    plan = topology.floorplan(*parts).filter("edge_id % 3 <> 1")
    return topology.unexpressed(parts[-1], plan)


@query("WITH e AS (SELECT n_nationkey AS edge_id, n_regionkey AS n1, 100 + n_nationkey % 7 AS n2 FROM nation), x AS (SELECT n1 AS v, edge_id FROM e UNION ALL SELECT n2, edge_id FROM e) SELECT v, count(*) AS degree, string_agg(edge_id, ',' ORDER BY edge_id) AS edges FROM x GROUP BY v")
def incident_edges(spark, d):
    tree = table(spark, d, "nation").select(F.lit("all").alias("key"), F.col("n_nationkey").alias("edge_id"), F.col("n_regionkey").alias("n1"), (F.col("n_nationkey") % 7 + 100).alias("n2"))
    return topology.incident_edges(tree).select("v", "degree", F.array_join(F.transform("edges", lambda x: x.cast("string")), ",").alias("edges"))


@query("SELECT count(DISTINCT vec_id) AS n FROM embeddings WHERE embedding[2] > 0")
def region_vertices(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("v"), F.element_at("embedding", 2).alias("g"))
    return statistics.distinct_in_region(rows, "v", F.col("g") > 0)


def _xyz(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")))


XYZ_SQL = "t AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
D2_SQL = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"WITH {XYZ_SQL} SELECT a.id, b.id AS \"on\", round({D2_SQL}, 9) AS d2 FROM t a, t b WHERE a.id % 10 <> 0 AND b.id % 50 = 0 ORDER BY {D2_SQL}, a.id, b.id LIMIT 1")
def nearest_to_path(spark, d):
    """Every fiftieth vector stands for a path."""
    t = _xyz(spark, d)
    return statistics.nearest_to_path(t.filter("id % 10 <> 0"), t.filter("id % 50 = 0")).select("id", "on", F.round("d2", 9).alias("d2"))


@query(f"""WITH {XYZ_SQL}, p AS (SELECT a.id % 5 AS "by", a.id AS a, b.id AS b, {D2_SQL} AS d2 FROM t a JOIN t b ON a.id % 5 = b.id % 5 WHERE a.label % 2 = 0 AND b.label % 2 = 1)
SELECT "by", a, b, round(d2, 9) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY "by" ORDER BY d2, a, b) = 1""")
def nearest_between_groups(spark, d):
    t = _xyz(spark, d).withColumn("by", F.col("id") % 5)
    return statistics.nearest_between(t.filter("label % 2 = 0"), t.filter("label % 2 = 1"), "by").withColumn("d2", F.round("d2", 9))


@query("""WITH s AS (SELECT (row_number() OVER (ORDER BY r_regionkey))::INT AS step, r_regionkey::BIGINT AS v FROM region)
SELECT step, v FROM s UNION ALL SELECT 0, 77 UNION ALL SELECT max(step) + 1, 88 FROM s""")
def boundary_path(spark, d):
    path = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("step"), F.col("r_regionkey").cast("long").alias("v"))
    return paths.boundary_path(path, 77, 88)


@query("SELECT n_name, (n_nationkey - 0)::INT AS idx, ((n_nationkey + 1) % 25)::INT AS \"next\", ((n_nationkey + 24) % 25)::INT AS \"previous\" FROM nation")
def storyboard_ring(spark, d):
    ring = paths.ring_neighbours(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    return ring.join(F.broadcast(names), "n_nationkey").select("n_name", "idx", F.col("next").cast("int").alias("next"), F.col("previous").cast("int").alias("previous"))  # nations are a fixed list


@query(f"WITH {KNN_SQL} SELECT src::INT AS src, dst::INT AS dst FROM edges")
def built_domain(spark, d):
    return neighbours.build_domain(points(spark, d), 10)[0]


@query("SELECT p_partkey, round((p_size - 10.0::DOUBLE) / (p_retailprice - 1000), 9) AS t FROM part WHERE p_retailprice <> 1000")
def line_crossings(spark, d):
    """Where the line from (0, 10) towards (1, a part's price less 990) reaches the height of the part's size."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p, q = at(F.lit(0), F.lit(10)), at(F.lit(1), F.col("p_retailprice") - 990)
    a, b = at(F.lit(0), F.col("p_size")), at(F.lit(1), F.col("p_size"))
    return table(spark, d, "part").withColumn("c", columns.crossing(p, q, a, b)).filter("c IS NOT NULL").select("p_partkey", F.round("c.t", 9).alias("t"))


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS f, min(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS lo, max(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS hi FROM embeddings),
s AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (f - lo) / (hi - lo) END AS s FROM e)
SELECT vec_id, CASE WHEN label = 1 THEN 1.0 ELSE round(s, 6) END AS r, CASE WHEN label = 1 THEN 0.0 ELSE round(1 - s, 6) END AS g FROM s""")
def vertex_colors(spark, d):
    """A vertex's place between the ends of its edge, from green to red; the selected edge is red."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("f"))
    ends = e.groupBy("label").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    green, red = colors.rgb(F.lit(0.0), F.lit(1.0), F.lit(0.0)), colors.rgb(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    picked = F.when(F.col("label") == 1, 1)
    c = colors.vertex_color(F.col("f"), F.col("hi"), F.col("lo"), lambda s: colors.between(green, red, s), picked, {1: (1.0, 0.0, 0.0)})
    return e.join(F.broadcast(ends), "label").select("vec_id", c.alias("c")).select("vec_id", six(F.col("c.r")).alias("r"), six(F.col("c.g")).alias("g"))  # a row for each edge


@query("""WITH h AS (SELECT p_partkey, (p_size % 6) AS k, p_size / 100.0::DOUBLE AS s FROM part)
SELECT p_partkey, round(CASE WHEN k IN (0, 1, 5) THEN 1.0 ELSE 1 - s END, 9) AS r, round(CASE WHEN k IN (1, 2, 3) THEN 1.0 ELSE 1 - s END, 9) AS g, round(CASE WHEN k IN (3, 4, 5) THEN 1.0 ELSE 1 - s END, 9) AS b FROM h""")
def hue_colors(spark, d):
    """Hues at the corners of the colour wheel, by a part's size."""
    c = colors.hsb((F.col("p_size") % 6) / 6.0, F.col("p_size") / 100.0, F.lit(1.0))
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", *(F.round(F.col(f"c.{k}"), 9).alias(k) for k in "rgb"))


@query("SELECT 'chat' AS kind, count(*) AS n, count(DISTINCT role) AS names FROM conversations UNION ALL SELECT 'event', count(*), count(DISTINCT event_type) FROM events")
def message_dispatch(spark, d):
    chats, events = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    messages = codec.encode_rows(chats, "chat").unionByName(codec.encode_rows(events, "event"))
    read = codec.dispatch(messages, {"chat": chats.schema, "event": events.schema})
    count = lambda kind, c: read[kind].agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("names"))
    return count("chat", "role").unionByName(count("event", "event_type"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/contourlake/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS conf_id, s_acctbal::FLOAT AS f FROM supplier")
def function_file(spark, d):
    """A function written as a text of numbers, one a line, and read back."""
    place = _folder(spark, "function")
    own = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("line"))
    files.write_lines(own, place, ("s_suppkey",))
    return files.read_function(spark, place)


@query("WITH m AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS conf_id, embedding FROM embeddings) SELECT conf_id, k::INT AS pos, embedding[k + 1]::DOUBLE AS x FROM m, range(64) r(k)")
def points_file(spark, d):
    """A point cloud written as one binary file and read back by byte ranges."""
    place = f"{_folder(spark, 'points')}.dat"
    files.write_points(points(spark, d), place)
    return files.read_points(spark, place).select("conf_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query("WITH m AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS conf_id, embedding FROM embeddings) SELECT conf_id, k::INT AS res_idx, CASE WHEN embedding[k + 1] > 0 THEN 'H' WHEN embedding[k + 1] > -0.1 THEN 'E' ELSE 'X' END AS label FROM m, range(21) r(k)")
def labels_file(spark, d):
    """Labels of 21 residues for each structure, written as one file of characters and read back by byte ranges."""
    place = f"{_folder(spark, 'labels')}.dat"
    letters = F.transform(F.slice("embedding", 1, 21), lambda x: F.when(x > 0, "H").when(x.cast("double") > -0.1, "E").otherwise("X"))
    files.write_labels(table(spark, d, "embeddings").select(F.col("vec_id").alias("conf_id"), F.array_join(letters, "").alias("text")), place)
    return files.read_labels(spark, place, 21)


_MESH = "WITH m AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS v, embedding FROM embeddings) "


def _mesh(spark, d):
    """Vertices of the first three components, and a triangle of every three in a row."""
    own = cut(numbered(table(spark, d, "embeddings").select("vec_id", "embedding"), [F.col("vec_id")], "v"), "mesh")
    vertices = own.select("v", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("xyz"))
    return vertices, own.filter("v % 3 = 0").select((F.col("v") / 3).cast("int").alias("face_id"), F.array("v", F.col("v") + 1, F.col("v") + 2).alias("v"))


@query(_MESH + "SELECT v, k::INT AS pos, embedding[k + 1]::DOUBLE AS x FROM m, range(3) r(k)")
def mesh_vertices(spark, d):
    """Vertices of an OBJ text written and read back."""
    place = f"{_folder(spark, 'mesh')}.obj"
    files.write_lines(files.obj_lines(*_mesh(spark, d)), place)
    return files.read_obj(spark, place)[0].select("v", F.posexplode("xyz").alias("pos", "x"))


@query(_MESH + "SELECT v // 3 AS face_id, k::INT AS pos, (v + k)::INT AS v FROM m, range(3) r(k) WHERE v % 3 = 0")
def mesh_faces(spark, d):
    """Faces of an OFF text written and read back."""
    place = f"{_folder(spark, 'mesh')}.off"
    files.write_lines(files.off_lines(*_mesh(spark, d)), place)
    return files.read_off(spark, place)[1].select("face_id", F.posexplode("v").alias("pos", "v"))


@query(f"WITH {KNN_SQL} SELECT src, dst FROM edges WHERE src % 2 = 0")
def domain_files(spark, d):
    """A domain written and read back."""
    place, own = _folder(spark, "domain"), cut(edges(spark, d), "edges").filter("src % 2 = 0")
    files.write_domain(own, own.select(F.col("src").alias("s_id"), F.col("dst").alias("conf_id")), place)
    return files.read_domain(spark, place)[0]


@query("SELECT r_name AS dataset, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def catalog(spark, d):
    """Folders of datasets (regions) and their projects (nations), listed."""
    root, n = _folder(spark, "catalog"), table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed lists
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for r in n.select("r_name", "n_name").collect():
        path = hadoop.Path(f"{root}/{r['r_name']}/{files.PROJECTS}/{r['n_name']}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return files.catalog(spark, root).select("dataset", F.array_join("names", ",").alias("names"))
