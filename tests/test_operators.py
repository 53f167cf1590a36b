"""Sources, functions, kernels and the session on small fixtures."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import colors, columns
from contourlake.kernels import geometry, linalg
from contourlake.operators import neighbours, paths, statistics, topology
from contourlake.operators import linalg as shapes
from contourlake.plans import cli, session
from contourlake.sources import codec, files, logs, structures

ATOMS = [
    "ATOM      1  N   ALA A   1      11.000  12.000  13.000",
    "ATOM      2  CA  ALA A   1       1.500  -2.250   3.000",
    "HETATM    3  CA  CA  A   2       9.000   9.000   9.000",
    "ATOM      4  CA  ALA A   7   -1234.567-234.567-999.999",
    "TER",
    "END",
]


def collect(df):
    return sorted(map(tuple, df.collect()))


def test_fixed_width_lines(spark):
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(ATOMS)], "conf_id long, line_no int, line string")
    got = collect(structures.backbone(lines))
    assert [r[:2] for r in got] == [(0, 0), (0, 1)]
    assert got[0][2:] == (1.5, -2.25, 3.0) and got[1][2:] == pytest.approx((-1234.567, -234.567, -999.999), rel=1e-6)
    assert collect(structures.residue_counts(lines)) == [(0, 7)]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    d = root / "alpha"
    (d / "scalar_functions" / "deep").mkdir(parents=True)
    (d / "collab_projects").mkdir()
    names = [f"run/x{i}.pdb" for i in range(6)]
    with zipfile.ZipFile(d / structures.ZIP_NAME, "w") as z:
        for i, n in enumerate(names):
            z.writestr(n, "\n".join([*ATOMS[:2], f"REMARK {i}"]) + "\n")
    (d / structures.ZIP_LIST).write_text("\n".join(names) + "\n")
    f = [10, 40, 70, 60, 80, 50]
    (d / "scalar_functions" / "energy.txt").write_text("\n".join(map(str, f)) + "\n")
    (d / "scalar_functions" / "deep" / "other.txt").write_text("1\n2\n3\n4\n5\n6\n")
    (d / files.LABELS).write_text("HEEXXC" * 2)
    points = spark.createDataFrame([(i, [float(i), 0.0, float(i % 2)]) for i in range(6)], "conf_id long, v array<float>")
    files.write_points(points, str(d / files.POINTS))
    edges = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (4, 5)], "src int, dst int")
    sample = spark.createDataFrame([(i, i) for i in range(6)], "s_id int, conf_id long")
    files.write_domain(edges, sample, str(d / "collab_projects" / "demo"))
    return str(root)


def test_dataset_and_session(spark, dataset):
    s = session.Session(spark, dataset, "ann", "alpha", "demo", "energy.txt")
    assert collect(files.catalog(spark, dataset)) == [("alpha", ["demo"])]
    assert sorted(r[0] for r in s.parts["functions"].select("name").collect()) == ["energy.txt", "other.txt"]
    assert collect(s.parts["points"].select("conf_id", F.col("v")[0]))[5] == (5, 5.0)
    assert {(r["n1"], r["n2"]) for r in s.tree(tau=0.0).collect()} == {(0, 3), (3, 4), (5, 3), (5, 2)}
    assert len(s.edge_areas(s.tree(0.0)).collect()) == 4
    assert [r["line"] for r in s.structure_lines(2).collect()][-1] == "REMARK 2"
    assert collect(s.find("run/x[12].pdb")) == [("run/x1.pdb", 1), ("run/x2.pdb", 2)]
    assert collect(s.find("x1")) == []
    with pytest.raises(Exception):
        s.find("[")
    assert "".join(r["label"] for r in s.labels(1, 6).orderBy("res_idx").collect()) == "HEEXXC"
    assert "".join(r["label"] for r in s.labels(4, 6).orderBy("res_idx").collect()) == "XXXXXX"
    told = s.areas(0.0).collect()
    assert len(told) == 1 and len(told[0]["areas"]) == 4 and told[0]["has_labels"] and len(told[0]["functions"]) > 0
    assert collect(s.contacts([0])) == [(i, 0) for i in range(6)]
    path = s.shortest_path(0, 5).orderBy("step").collect()
    assert [r["v"] for r in path][0] == 0 and [r["v"] for r in path][-1] == 5
    assert s.refresh("chat").count() == 0
    s.say("hello")
    s.annotate("a", 2, [0.0] * 16, "t1")
    s.tell("b", "t2", [("a", 2, "t1")])
    assert [r["line"].endswith("ann > hello") for r in s.refresh("chat").collect()] == [True]
    resolved = session.resolve_storyboards(s.refresh("storyboards").select("name", "annotations"), s.refresh("annotations").select("name", "ts", "s_id", "pdb"))
    assert [(r["board"], r["name"], r["pdb"][-1]) for r in resolved.collect()] == [("b", "a", "REMARK 2")]
    none = s.refresh("annotations").filter("s_id = 99").select("name", "ts", "s_id", "pdb")
    with pytest.raises(Exception, match="unknown annotation"):
        session.resolve_storyboards(s.refresh("storyboards").select("name", "annotations"), none).collect()
    other = session.Session(spark, dataset, "bob", "alpha", "demo", "deep/other.txt")
    assert other.refresh("chat").count() == 0


def test_missing_parts_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.open_dataset(spark, str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError):
        structures.conformations(spark, str(tmp_path))


def test_file_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pdb").write_text("x\ny\n")
    (tmp_path / structures.FILE_LIST).write_text("a/one.pdb\n")
    assert collect(structures.structure_lines(spark, str(tmp_path))) == [(0, "a/one.pdb", 0, "x"), (0, "a/one.pdb", 1, "y")]


def test_one_structure(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("one.pdb", "x\ny\n"), ("[1]*.pdb", "z\n"), ("1.pdb", "no\n")):
        (tmp_path / "a" / name).write_text(text)
    (tmp_path / structures.FILE_LIST).write_text(f"a/one.pdb\na/[1]*.pdb\na/missing.pdb\n{tmp_path}/a/one.pdb\n")
    read = lambda i: collect(structures.one_structure(spark, str(tmp_path), i))
    assert read(0) == [(0, "a/one.pdb", 0, "x"), (0, "a/one.pdb", 1, "y")]
    assert read(1) == [(1, "a/[1]*.pdb", 0, "z")]
    assert read(2) == read(9) == []
    assert [r[3] for r in read(3)] == ["x", "y"]
    files_read = structures.one_structure(spark, str(tmp_path), 0).inputFiles()
    assert [f.rsplit("/", 1)[1] for f in files_read] == ["one.pdb"]


def test_one_structure_of_an_archive(spark, dataset):
    every = collect(structures.structure_lines(spark, f"{dataset}/alpha"))
    assert collect(structures.one_structure(spark, f"{dataset}/alpha", 4)) == [r for r in every if r[0] == 4]
    assert collect(structures.one_structure(spark, f"{dataset}/alpha", 6)) == []
    s = session.Session(spark, dataset, "ann", "alpha", "demo", "energy.txt")
    assert collect(s.structure_lines(99)) == []


def test_meshes(spark, tmp_path):
    v = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.5])], "v int, xyz array<double>")
    f = spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 2])], "face_id int, v array<int>")
    for write, read in ((files.obj_lines, files.read_obj), (files.off_lines, files.read_off)):
        out = str(tmp_path / write.__name__)
        files.write_lines(write(v, f), out)
        part = next(p for p in (tmp_path / write.__name__).iterdir() if p.name.startswith("part"))
        gv, gf = read(spark, str(part))
        assert collect(gv) == collect(v) and collect(gf) == collect(f)


def test_binary_domain(spark, tmp_path):
    path = tmp_path / "domain"
    path.write_bytes(np.array([2, 0, 1, 2, 1, 3, 5, 7, 9], ">i4").tobytes())
    edges, sample = files.read_binary_domain(spark, str(path))
    assert collect(edges) == [(0, 1), (1, 2)] and collect(sample) == [(0, 5), (1, 7), (2, 9)]


def test_contacts_and_steps(spark):
    xyz = [(0, 0, 0), (3.8, 0, 0), (3.8, 3.8, 0), (0, 3.8, 0), (0, 3.8, 8)]
    b = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "conf_id long, res_idx int, x float, y float, z float")
    assert collect(statistics.contact_density(b)) == [(1, 6)]
    whole = b.groupBy("conf_id").agg(F.array_sort(F.collect_list(F.struct("res_idx", "x", "y", "z"))).alias("b"))
    v = whole.select(columns.pairwise_distances(F.col("b"))).first()[0]
    assert v == pytest.approx([3.8, 5.374, 3.8, 8.8566, 3.8, 5.374, 9.6374, 3.8, 8.8566, 8.0], abs=1e-3)
    assert len(whole.select(columns.pairwise_distances(F.col("b"), 4)).first()[0]) == 10
    one = whole.select(columns.pairwise_distances(F.slice("b", 1, 1))).first()[0]
    assert one == []


def test_spread_and_histogram(spark):
    p = spark.createDataFrame([("a", [float(x), float(y)]) for x in (0, 2) for y in (0, 2)] + [("b", [1.0, 1.0])] * 3, "g string, v array<double>")
    assert dict(collect(statistics.spread(p, "g"))) == {"a": pytest.approx(1.885618, abs=1e-6), "b": 0.1}
    f = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10)], "f double")
    assert [r[1] for r in collect(statistics.histogram(f, 4))] == [0.3, 0.2, 0.3, 0.2]
    flat = spark.createDataFrame([(5.0,)] * 3, "f double")
    assert [r[1] for r in collect(statistics.histogram(flat, 3))] == [1.0, 0.0, 0.0]
    assert [r[1] for r in collect(statistics.density(statistics.histogram(flat, 3, closed=False)))][0] == 1.0
    g = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0)], "e int, f double, g double")
    assert statistics.component_statistics(g, "e").first()["corr_fg"] == 1.0


def test_natural_order(spark):
    names = ["f10", "f2", "f02", "F1", "_a", "1z"]
    df = spark.createDataFrame([(n,) for n in names], "name string").orderBy(columns.natural_key(F.col("name")))
    assert [r[0] for r in df.collect()] == ["1z", "_a", "F1", "f02", "f2", "f10"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(12345.0, "a.TXT"), (0.0, "b"), (-0.012345, ".txt"), (9999.9, "x.txt.txt")], "x double, n string")
    got = df.select(columns.scientific(F.col("x")), columns.menu_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("12.34E3", "a"), ("00.00E0", "b"), ("-12.34E-3", ""), ("10.00E3", "x.txt")]
    assert df.select(columns.gradient(F.lit(1.0), F.lit(3.0), F.lit(0.0)), columns.level_share(F.lit(2.0), F.lit(1.0), F.lit(1.0))).first() == (0.0, 0.0)


def test_sample_lists(spark):
    p = spark.createDataFrame([(0, "a/x1.pdb"), (1, "a/x10.pdb"), (2, "b/x1.pdb")], "conf_id long, path string")
    names = spark.createDataFrame([("a/x1.pdb",), ("b/x1.pdb",), ("a/x1.pdb",)], "path string")
    assert collect(neighbours.sample_map(p, names)) == [(0, 0), (1, 2)]
    assert collect(neighbours.sample_map(p, names, keep=False)) == [(0, 1)]
    assert collect(neighbours.sample_map(p)) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        neighbours.build_domain(p, 1)


@pytest.mark.parametrize("d", [3, 8, 24, 64])
@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_is_exact(spark, monkeypatch, d, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = np.random.default_rng(d).integers(0, 3 if d < 9 else 50, (60, d)).astype(float)  # many ties and copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "conf_id long, v array<double>")
    got = {}
    for r in neighbours.nearest(df, 5).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(60):
        d2 = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(60), d2)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == order
    few = df.filter("conf_id < 3")
    assert neighbours.nearest(few, 5).count() == 6


def test_build_domain(spark):
    far = spark.createDataFrame([(i, [float(i % 4) + 100 * (i // 4), 0.0]) for i in range(8)], "conf_id long, v array<double>")
    with pytest.raises(ValueError, match="2 components"):
        neighbours.build_domain(far, 2)
    edges, sample = neighbours.build_domain(far, 5)
    assert sample.count() == 8 and edges.filter("src >= dst").isEmpty()


def test_components_and_costs(spark):
    v = spark.createDataFrame([(i,) for i in range(30)], "v long")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(21, 25), (25, 29)], "src long, dst long")
    got = dict(collect(neighbours.components(v, e)))
    assert all(got[i] == 0 for i in range(20)) and got[20] == 20 and {got[i] for i in (21, 25, 29)} == {21}
    w = e.withColumn("w", F.lit(0.5))
    assert dict(collect(paths.path_costs(w, 0))) == {i: 0.5 * i for i in range(20)}


def test_many_projects_in_one_plan(spark):
    f = {"a": [10, 40, 70, 60, 80, 50], "b": [1, 5, 2, 9, 3, 8]}
    v = spark.createDataFrame([(k, i, float(x)) for k in f for i, x in enumerate(f[k])], "key string, v long, f double")
    e = spark.createDataFrame([("a", *p) for p in [(0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (4, 5)]] + [("b", i, i + 1) for i in range(5)], "key string, src long, dst long")
    arcs = topology.contour_arcs(v, e)
    assert collect(arcs.filter("key = 'a'").select("lo", "hi")) == [(0, 1), (1, 3), (3, 4), (5, 2), (5, 3)]
    assert arcs.filter("key = 'b'").count() == 5
    tree = topology.tree_edges(v, e)
    cut = {(r["key"], r["edge_id"]): r["visible"] for r in topology.region(tree.filter("key = 'a'"), 3).collect()}
    assert cut[("a", 1)] in (True, False) and len(cut) == 4


def test_geometry():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
    assert geometry.signed_area(square) == 1 and geometry.signed_area(square[::-1]) == -1
    assert geometry.centroid(square) == pytest.approx([0.5, 0.5])
    assert geometry.centroid(np.array([[0, 0], [1, 1], [2, 2.0]])) == pytest.approx([1, 1])
    parts = geometry.slices(square, [0.1, 0.25, 0.05, 0.6])
    assert [abs(geometry.signed_area(p)) for p in parts] == pytest.approx([0.1, 0.25, 0.05, 0.6])
    assert abs(geometry.signed_area(geometry.scale(square, 0.5))) == pytest.approx(0.25)


def test_eigenvalues():
    a = np.zeros((6, 6))
    for i, j in [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]:
        a[i, j] = a[j, i] = 1
    b = np.array([2, 2, 3, 3, 2, 2.0])
    values, vectors = linalg.generalised_eigenpairs(a, b, 4)
    assert values == pytest.approx([1, 0.795334, -1 / 6, -0.5], abs=1e-6)
    for value, x in zip(values, vectors):
        assert a @ x == pytest.approx(value * b * x, abs=1e-9)


def test_principal_components():
    x = np.random.default_rng(0).normal(size=(40, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    for rows in (x, x[:4]):
        mean, parts, variances = linalg.principal_components(rows, 3)
        assert parts @ parts.T == pytest.approx(np.eye(3), abs=1e-9)
        assert ((rows - mean) @ parts.T).var(axis=0, ddof=1) == pytest.approx(variances)


def test_alignment(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 3))
    t = 0.7
    turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    assert linalg.procrustes(np.stack([base, base @ turn.T + 5]))[2] == pytest.approx([0, 0], abs=1e-9)
    mirrored = base * [1, 1, -1]
    assert linalg.procrustes(np.stack([base, mirrored]))[2].max() > 0.1
    df = spark.createDataFrame([("g", i, s.tolist()) for i, s in enumerate([base, base @ turn.T, base[:5]])], "g string, conf_id long, xyz array<array<double>>")
    got = {r["conf_id"]: (r["rmsd"], r["used"]) for r in shapes.alignment(df, "g").collect()}
    assert got[0][0] == pytest.approx(0, abs=1e-9) and got[2] == (None, False)


def test_colors(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0)], "s double")
    low, middle, high = (r[0] for r in df.select(colors.diverging(F.col("s"))).collect())
    assert tuple(low) == pytest.approx(colors.BLUE, abs=0.01) and tuple(high) == pytest.approx(colors.RED, abs=0.01)
    assert tuple(middle) == pytest.approx((0.865, 0.865, 0.865), abs=0.01)
    jet = [tuple(r[0]) for r in df.select(colors.jet(F.col("s"))).collect()]
    assert jet == [(0, 0, 0.5), (0.5, 1, 0.5), (0.5, 0, 0)]
    red, green = df.select(colors.composition_color(F.lit(2), F.lit(0), F.lit(1), (4, 1, 2))).first()[0][:2]
    assert (red, green) == (0.5, 0.0)


def test_logs_are_empty_at_first(spark, tmp_path):
    for kind in logs.SCHEMAS:
        assert logs.read_log(spark, str(tmp_path), kind).count() == 0


def test_ring(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert collect(paths.ring_neighbours(items, "name")) == [("a", 0, 1, 2), ("b", 1, 2, 0), ("c", 2, 0, 1)]


def test_nearest_between(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 5.0, 0.0, 0.0)], "g int, id int, x double, y double, z double")
    b = spark.createDataFrame([(1, 9, 4.0, 0.0, 0.0), (1, 8, 6.0, 0.0, 0.0)], "g int, id int, x double, y double, z double")
    assert collect(statistics.nearest_between(a, b, "g")) == [(1, 2, 8, 1.0)]


def test_command_line(spark, tmp_path):
    d = tmp_path / "beta"
    (d / "scalar_functions").mkdir(parents=True)
    rng = np.random.default_rng(1)
    names = []
    for i in range(12):
        lines = [f"ATOM  {j + 1:5d}  CA  ALA A{j + 1:4d}    {rng.normal():8.3f}{rng.normal():8.3f}{rng.normal() + j:8.3f}" for j in range(5)]
        names.append(f"s{i}.pdb")
        (d / names[-1]).write_text("\n".join(lines) + "\n")
    (d / structures.FILE_LIST).write_text("\n".join(names) + "\n")
    (d / "scalar_functions" / "f.txt").write_text("\n".join(map(str, range(12))) + "\n")
    black = tmp_path / "black.txt"
    black.write_text("s3.pdb\ns4.pdb\n")
    (d / "s0.pdb").rename(d / "whole")
    (d / "s0.pdb").write_text("\n".join((d / "whole").read_text().split("\n")[:4]) + "\n")
    with pytest.raises(ValueError, match="2 lengths"):
        cli.main(["points", str(d), "--components", "3"], spark)
    (d / "whole").rename(d / "s0.pdb")
    cli.main(["points", str(d), "--components", "3"], spark)
    points = files.read_points(spark, str(d / files.POINTS))
    assert points.count() == 12 and len(points.first()["v"]) == 3
    for wrong in (["domain", "1", str(d), "p"], ["domain", "3", str(d / "no"), "p"], ["domain", "-w", "a", "-b", "b", "3", str(d), "p"], []):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)
    cli.main(["domain", "-b", str(black), "6", str(d), "p"], spark)
    edges, sample = files.read_domain(spark, str(d / files.PROJECTS / "p"))
    assert {r["conf_id"] for r in sample.collect()} == set(range(12)) - {3, 4} and edges.count() > 0


def test_natural_order_of_long_numbers(spark):
    names = ["f3" + "0" * 20, "f2" + "0" * 24, "f7" + "0" * 23, "f" + "9" * 24, "f2", "f10"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(columns.natural_key(F.col("n"))).collect()]
    assert got == sorted(names, key=lambda n: int(n[1:]))


def test_region_of_negative_vertices(spark):
    tree = spark.createDataFrame([("k", 0, -7, -5, [-7, -5]), ("k", 1, -5, 1, [-5, 1])], "key string, edge_id int, n1 long, n2 long, members array<long>")
    assert sorted((r["edge_id"], r["visible"]) for r in topology.region(tree, -5).collect()) == [(0, True), (1, False)]


def test_long_chain_of_costs(spark):
    n = 40
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    got = {r["v"]: r["cost"] for r in paths.path_costs(chain, 0).collect()}
    assert got == {i: float(i) for i in range(n + 1)}


def test_terrain_positions_and_split(spark):
    rows = [("k", 0, 0, 0, 0.0, 0.0, 1.0, 5), ("k", 0, 0, 1, 1.0, 0.0, 1.0, None), ("k", 0, 1, 0, 0.0, 0.0, 1.0, 5), ("k", 1, 0, 0, 2.0, 0.0, 1.0, 5), ("k", 1, 0, 1, 2.0, 0.0, 1.0, 6)]
    t = spark.createDataFrame(rows, "key string, edge_id int, tri int, corner int, x double, y double, z double, ct_node long")
    got = {r["v"]: [tuple(p) for p in r["positions"]] for r in topology.terrain_positions(t).collect()}
    assert got == {5: [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0)], 6: [(2.0, 0.0, 1.0)]}
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    right, left = geometry.split_by_segment(square, np.array([0.25, 0]), np.array([0.25, 1]))
    assert geometry.signed_area(right) == pytest.approx(0.75) and geometry.signed_area(left) == pytest.approx(0.25)


def test_unknown_class_raises(spark):
    messages = spark.createDataFrame([("a", '{"x":1}'), ("b", "{}")], "class string, payload string")
    schema = spark.createDataFrame([], "x int").schema
    with pytest.raises(Exception, match="unknown class"):
        codec.dispatch(messages, {"a": schema})["a"].collect()


def test_boundary_of_an_empty_path(spark):
    assert paths.boundary_path(spark.createDataFrame([], "step int, v long"), 1, 2).count() == 0
