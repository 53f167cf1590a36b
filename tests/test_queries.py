"""Every registered query of the topological operators on the smallest tables, against its SQL where it has one."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from contourlake.plans.queries import QUERIES, SQL, entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = tables.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
    else:
        assert len(got)


def test_variance_of_all_rows(spark, tmp_path):
    """More rows than a basis is fitted on, and one far off."""
    rows = spark.range(3500).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 65))).cast("array<float>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(F.col("vec_id") % 7 == 3, F.transform("embedding", lambda x: x * 9)).otherwise(F.col("embedding")))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    sql = SQL["pca_variance"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet' AS embeddings")
    assert QUERIES["pca_variance"](spark, str(tmp_path)).first()[0] == duckdb.sql(sql).fetchall()[0][0]


def test_halves_of_engineering_format(spark, tmp_path):
    """Every number of cents that ends in 5 between -1000 and 10000, and halves of other sizes, as the SQL rounds them."""
    cents = spark.range(-99995, 1000000, 10).select(F.col("id").alias("s_suppkey"), (F.col("id") / 100.0).alias("s_acctbal"))
    other = spark.range(5, 20005, 10).select((F.col("id") + 2000000).alias("s_suppkey"), (F.col("id") / F.pow(F.lit(10.0), (F.col("id") / 10 % 9).cast("int"))).alias("s_acctbal"))
    cents.unionByName(other).write.parquet(str(tmp_path / "supplier.parquet"))
    got = dict(QUERIES["engineering_format"](spark, str(tmp_path)).collect())
    want = dict(duckdb.sql(SQL["engineering_format"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")).fetchall())
    assert got == want and dict(got)[41215] == "41.22E1"


def test_entry(spark):
    out = entry(spark, DATA).toPandas()
    assert out["n"].sum() == 500 and len(out) == 1


def test_tree_tables_agree(spark):
    q = lambda name: QUERIES[name](spark, DATA).toPandas()
    arcs, classes, edges, members = q("contour_tree"), q("tree_node_classes"), q("contracted_tree"), q("component_members")
    assert len(arcs) == 499 and classes["up"].sum() == 499
    critical = (classes["node_class"] != "ordinary").sum()
    assert len(edges) == critical - 1
    assert members["v"].nunique() == 500
    pairs = q("persistence_pairs")
    assert not (pairs["extremum"] == pairs["killed_by"]).any()


def test_floor_plan_conserves_area(spark):
    plan = QUERIES["floorplan_polygons"](spark, DATA).toPandas()
    tree = QUERIES["bsp_subtree_area"](spark, DATA).toPandas().set_index("edge_id")
    whole = tree.loc[tree["parent_edge"].isna(), "sum_area"].sum()
    for r in plan.itertuples():
        p = [(q["x"], q["y"]) for q in r.polygon]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2)
        assert area == pytest.approx(tree.loc[r.edge_id, "sum_area"] / whole, rel=1e-4, abs=1e-9)
