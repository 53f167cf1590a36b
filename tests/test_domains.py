"""Trees over tables against the kernels: slabs, rounds, plateaus, simplification, and what no task sees."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.kernels import topology as kernel
from contourlake.operators import contour, graph, merge, topology

VERTICES, EDGES = "key string, v long, f double", "key string, src long, dst long"


def graphs(connected):
    """key -> (ids, f, edges): sparse and dense, with ties, some without a single edge."""
    out = {}
    for g in range(20):
        r = random.Random(g)
        n = r.choice([1, 2, 7, 40, 90])
        ids = r.sample(range(-500, 500), n)
        f = [r.choice([0.0, -0.0, 1.0, r.random()]) for _ in ids]
        edges = [(r.choice(ids), r.choice(ids)) for _ in range(r.choice([0, n // 2, 3 * n]))]
        if connected:
            edges += [(ids[i], ids[r.randrange(i)]) for i in range(1, n)]
        out[f"g{g:02}"] = ids, f, edges
    return out


def tables(spark, own):
    v = [(k, a, b) for k, (ids, f, _) in own.items() for a, b in zip(ids, f, strict=True)]
    e = [(k, a, b) for k, (*_, edges) in own.items() for a, b in edges]
    # Repeats, loops and edges to nowhere change nothing.
    e += e[:5] + [(k, a, a) for k, a, _ in v[:3]] + [(v[0][0], v[0][1], 10**9)]
    return spark.createDataFrame(v + v[:4], VERTICES), spark.createDataFrame(e, EDGES)


def sound(d):
    """Whether the merge trees have a contour tree."""
    tree = kernel.domain_of(d, [(a, b) for a, b in kernel.contour_tree(d)])
    return kernel.join_tree(tree) == kernel.join_tree(d) and kernel.split_tree(tree) == kernel.split_tree(d)


def test_merge_trees_of_slabs(spark, slabs=8):
    own, trees, pairs = graphs(False), set(), set()
    for k, x in own.items():
        d = kernel.Domain(*x)
        name = lambda r, d=d: int(d.ids[r]) if r >= 0 else None
        trees |= {(k, t, name(v), name(p)) for t, ps in (("join", kernel.join_tree(d)), ("split", kernel.split_tree(d))) for v, p in enumerate(ps)}
        pairs |= {(k, name(a), name(b), name(c), p, s) for a, b, c, p, s in kernel.persistence_pairs(d)}
    v, e = tables(spark, own)
    got = list(map(tuple, merge.merge_trees(v, e, slabs).collect()))
    assert set(got) == trees and len(got) == len(trees)
    got = list(map(tuple, merge.persistence(v, e, slabs).collect()))
    assert set(got) == pairs and len(got) == len(pairs)


def test_no_slab_holds_all_links(spark):
    """Of a graph with three links a vertex, the most that one task sweeps is about a slab's share, and vertices above it have become few."""
    r = random.Random(1)
    links = {tuple(sorted(r.sample(range(2000), 2))) for _ in range(6000)}
    df = spark.createDataFrame(sorted(links), "lo long, hi long")
    both = df.select("lo", "hi").unionByName(df.select((3999 - F.col("hi")).alias("lo"), (3999 - F.col("lo")).alias("hi")))
    within = F.floor((F.col("lo") % 2000) / 250).cast("long")
    current = both.withColumn("top", F.col("hi")).withColumn("slab", F.when(F.col("lo") >= 2000, 8).otherwise(0).cast("long") + within)
    for shift in (3, 2, 1):
        current = merge._contract(current, shift, 2000)
    seen = {r["slab"]: r["count"] for r in current.groupBy("slab").count().collect()}
    # A slab of the lowest eighth has about 1,400 links at first, nearly all to one component in the end.
    assert len(seen) >= 14 and sum(seen.values()) < len(links) and max(seen.values()) < len(links) / 4


@pytest.mark.parametrize("tau", [None, 0.3])
def test_contour_trees_by_rounds(spark, tau):
    own = {k: x for k, x in graphs(True).items() if sound(kernel.Domain(*x))}
    arcs, trees = set(), set()
    for k, x in own.items():
        d = kernel.Domain(*x)
        name = lambda r, d=d: int(d.ids[r])
        tree = kernel.build_tree(d) if tau is None else kernel.simplify(d, tau)
        arcs |= {(k, name(a), name(b)) for a, b in tree.arcs()}
        trees |= {(k, i, name(a), name(b), tuple(sorted(map(name, m)))) for i, (a, b, m) in enumerate(kernel.contract(tree))}
    v, e = tables(spark, own)
    # Simplified domains may have cycles; those stay with the kernel.
    rows = list(map(tuple, contour.contour_arcs(v, e, tau, task_rows=3 if tau is None else 10**6).collect()))
    assert set(rows) == arcs and len(rows) == len(arcs)
    tree, members = contour.critical_tree(v, e, tau)
    inside = defaultdict(list)
    for k, edge, x in members.collect():
        inside[k, edge].append(x)
    assert {(k, i, a, b, tuple(sorted(inside[k, i]))) for k, i, a, b in tree.collect()} == trees


def test_a_path_is_one_round(spark):
    """100,000 vertices in a chain: rounds and doublings, not steps."""
    n = 100_000
    parents = spark.range(n).select(F.lit("p").alias("key"), F.col("id").alias("rank"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pj"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("ps"))
    arcs, rounds = contour.combined(parents, task_rows=1000)
    assert rounds == 1 and arcs.count() == n - 1 and arcs.filter("hi <> lo + 1").isEmpty()


def test_domains_without_a_contour_tree(spark):
    """Rounds end, and give a tree's number of arcs at most."""
    own = {k: x for k, x in graphs(True).items() if not sound(kernel.Domain(*x))}
    assert own
    v, e = tables(spark, own)
    found = defaultdict(int)
    for k, _, _ in contour.contour_arcs(v, e, task_rows=1).collect():
        found[k] += 1
    assert all(0 < found[k] <= len(ids) for k, (ids, *_) in own.items())


def test_large_and_small_domains_agree(spark, monkeypatch):
    own = {k: x for k, x in list(graphs(True).items())[:6] if sound(kernel.Domain(*x))}
    v, e = tables(spark, own)
    got = []
    for rows in (10**6, 0):
        monkeypatch.setattr(topology, "DOMAIN_ROWS", rows)
        got.append([sorted(map(tuple, f(v, e, **t).collect())) for f, t in ((topology.contour_arcs, {}), (topology.tree_edges, {}), (topology.member_rows, {"tau": 0.2}))])
    small, large = got
    assert small[0] == large[0] and small[2] == large[2] and [(*r[:4], sorted(r[4])) for r in small[1]] == [(*r[:4], sorted(r[4])) for r in large[1]]


def test_components_and_chains(spark):
    r = random.Random(4)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1800)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    low = graph.least_reachable(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 3000)
    want = {x: int(low[x]) for e in edges for x in e if e[0] != e[1]}
    got = graph.connected_components(df).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)
    steps = [(i, i + r.choice([1, 2, 50])) for i in range(0, 2000) if i % 97]
    ends, to = {}, dict(steps)
    for i in to:
        x = i
        while x in to:
            x = to[x]
        ends[i] = x
    got = graph.chain_ends(spark.createDataFrame(steps, "id long, to long").repartition(5)).collect()
    assert {x["id"]: x["end"] for x in got} == ends
    assert graph.connected_components(df.limit(0)).isEmpty() and graph.chain_ends(spark.createDataFrame([], "id long, to long")).isEmpty()


def brute_neighbours(x, k):
    want = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k], 1):
            want[i, int(j), rank] = d[j]
    return want


@pytest.mark.parametrize("task_rows", [None, 0, 900])
def test_components_end_in_a_task(spark, monkeypatch, task_rows):
    """Components by rounds to the end, by rounds until the rest fits a task, and at once in a task: the same, and few tables where it fits."""
    from contourlake.operators import graph

    r = np.random.default_rng(2)
    a, b = r.permutation(1500), r.permutation(1500)
    path = [(int(x), int(y)) for n in (a[:1200], a[1200:1201], a[1201:]) for x, y in zip(n, n[1:])] + [(int(x), int(y)) for x, y in zip(b[:50], b[50:100])]
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    if task_rows is not None:
        monkeypatch.setattr(graph, "TASK_ROWS", task_rows)
    df = spark.createDataFrame(path, "a long, b long").repartition(7)
    low = graph.least_reachable(np.array([p for p, _ in path]), np.array([q for _, q in path]), 1500)
    nodes = {n for p in path for n in p}
    assert sorted(map(tuple, graph.connected_components(df).collect())) == [(n, int(low[n])) for n in sorted(nodes)]
    assert len(written) <= 2 or task_rows is not None


@pytest.mark.parametrize("structure", [True, False])
def test_pruned_neighbours(spark, structure):
    """Exact with repeated vectors and ties; where vectors stand in groups, less than a fifth of all distances are computed."""
    from contourlake.operators import neighbours

    r = np.random.default_rng(1)
    n = 4000 if structure else 600
    centres = r.normal(size=(40, 24)) * (5 if structure else 0)
    x = (centres[r.integers(0, 40, n)] + r.normal(size=(n, 24)) * (0.3 if structure else 1)).astype(np.float32)
    x[10] = x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (n, None)], "conf_id long, v array<float>")
    found, computed = neighbours.nearest_counted(df, 5, block=100)
    got, want = {(a, b, q): d for a, b, q, d in found.collect()}, brute_neighbours(x.astype(float), 5)
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 1e-9
    share = computed.first()[0] / n**2
    assert share < 0.2 if structure else share <= 2


def test_few_distances_without_structure(spark):
    """Vectors without groups: a product of matrices leaves a tenth of all distances at most, over several tasks a block."""
    from contourlake.operators import neighbours

    n = 3000
    x = np.random.default_rng(4).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "conf_id long, v array<float>")
    found, computed = neighbours.nearest_counted(df, 5, block=200)
    want = brute_neighbours(x.astype(float), 5)
    assert {(a, b, q): d for a, b, q, d in found.collect()}.keys() == want.keys()
    assert computed.first()[0] < 0.1 * n**2


@pytest.mark.parametrize("size,shift", [(1.0, 0.0), (1e-30, 0.0), (1e30, 0.0), (1e-3, 1e6), (0.0, 3.0)])
def test_products_keep_what_is_within(size, shift):
    """No neighbour is lost for large, small, far off, mixed and repeated vectors, with bounds that are met exactly."""
    from contourlake.operators import neighbours

    r = np.random.default_rng(6)
    x = r.normal(size=(500, 20)) * size + shift
    x[::7], x[5] = x[3], x[5] * 1e6
    ids = r.permutation(500)
    d2 = neighbours._squared(x, x)
    d2[np.arange(500), np.arange(500)] = np.inf
    want = {(int(ids[i]), int(ids[j]), d2[i, j]) for i in range(500) for j in np.lexsort((ids, d2[i]))[:6] if np.isfinite(d2[i, j])}
    for bound in (np.full(500, np.inf), np.sort(d2, axis=1)[:, 5]):
        src, dst, d, _ = neighbours._search(x, ids, bound, x, ids, 6)
        assert {(int(a), int(b), c) for a, b, c in zip(src, dst, d)} == want


@pytest.mark.parametrize("size,shift", [(1.0, 0.0), (1e-30, 0.0), (1e30, 0.0), (1e-3, 1e6), (0.0, 3.0)])
@pytest.mark.parametrize("sides", [1, 2])
def test_one_product_serves_both_rows(size, shift, sides):
    """Blocks that meet once give the nearest of the rows of both, in two sides or among each other."""
    from contourlake.operators import neighbours

    r = np.random.default_rng(8)
    x = r.normal(size=(700, 20)) * size + shift
    x[::7], x[5] = x[3], x[5] * 1e6
    ids, block = r.permutation(700), np.repeat([3, 4, 9, 12], [300, 6, 290, 104])
    second = block >= (9 if sides == 2 else 99)
    d2 = neighbours._squared(x, x)
    d2[second[:, None] == second[None] if sides == 2 else block[:, None] == block[None]] = np.inf
    want = {(int(ids[i]), int(ids[j]), d2[i, j]) for i in range(700) for j in np.lexsort((ids, d2[i]))[:6] if np.isfinite(d2[i, j])}
    for bound in (np.full(700, np.inf), np.sort(d2, axis=1)[:, 5]):
        src, dst, d, _ = neighbours._search_both(x, ids, bound, block, second, 6)
        found, n = {}, 6 * 700 * (3 - sides)
        for a, c, b in sorted(zip(src.tolist(), d.tolist(), dst.tolist())):
            found.setdefault(a, []).append((a, b, c))
        assert len(src) <= n and {p for own in found.values() for p in own[:6]} == want


def test_segment_bounds_hold():
    from contourlake.operators import neighbours

    r = np.random.default_rng(3)
    x = r.normal(size=(60, 37)) + r.normal(size=(60, 1))
    whole = neighbours._squared(x, x)
    bounds = [neighbours._squared(s, s) for s in neighbours.segment_sketches(x)]
    assert all((b <= whole + 1e-9).all() for b in bounds)


def test_paths_by_tables(spark):
    """Several starts and ends, edges of no length, ties, unreachable ends, a long chain: as by the kernel."""
    from contourlake.operators import paths

    rows, want = [], set()
    for g in range(8):
        r = random.Random(g)
        n = 30
        edges = [(r.randrange(n), r.randrange(n), float(r.choice([0, 1, 1, 2, 5]))) for _ in range((20, 60)[g % 2])] if g else [(i, i + 1, 0.5) for i in range(n)]
        rows += [(f"g{g}", *e) for e in edges]
        names = sorted({x for e in edges for x in e[:2]} | {0, 3, 7, 29})
        cost, path = kernel.cheapest_path(len(names), [(names.index(a), names.index(b), w) for a, b, w in edges], [names.index(0), names.index(3)], [names.index(7), names.index(29)])
        want |= {(f"g{g}", i, names[v], cost) for i, v in enumerate(path)}
    df = spark.createDataFrame(rows, "key string, src long, dst long, w double")
    got = {tuple(x) for x in paths.path_by_tables(df, [0, 3], [7, 29]).collect()}
    ends = lambda found: {(k, c) for k, _, _, c in found}
    assert ends(got) == ends(want)
    # Where several paths cost the same, edges of no length may make them differ; each is a path.
    cheapest = {}
    for k, a, b, w in rows:
        for e in ((k, a, b), (k, b, a)):
            cheapest[e] = min(w, cheapest.get(e, w))
    for key, cost in ends(got):
        own = [v for _, v in sorted((s, v) for k, s, v, _ in got if k == key)]
        assert own[0] in (0, 3) and own[-1] in (7, 29) and abs(sum(cheapest[key, a, b] for a, b in zip(own, own[1:])) - cost) < 1e-9


def test_nearest_pairs_by_cells(spark):
    """Far apart, inside each other, equal positions, one position, negative coordinates; a group without a partner gives none."""
    from contourlake.operators import statistics

    r, a, b, want = random.Random(8), [], [], set()
    for g, (n, m, wide, off) in enumerate([(200, 300, 1.0, 0.0), (50, 60, 1.0, 40.0), (1, 80, 5.0, -3.0), (40, 40, 0.0, 0.0), (30, 30, 2.0, 0.0)]):
        own = [(g, i, *(r.gauss(0, wide) for _ in range(3))) for i in range(n)]
        other = [(g, 1000 + i, *(r.gauss(off, wide) for _ in range(3))) for i in range(m)]
        if g == 4:
            other[7] = (g, 1007, *own[5][2:])
            other[3] = (g, 1003, *own[5][2:])
        a, b = a + own, b + other
        want.add(min((sum((p - q) ** 2 for p, q in zip(x[2:], y[2:])), g, x[1], y[1]) for x in own for y in other)[1:])
    a.append((9, 1, 0.0, 0.0, 0.0))
    kind = "g int, id int, x double, y double, z double"
    got = {(x["g"], x["a"], x["b"]) for x in statistics.nearest_between(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "g").collect()}
    assert got == want


def test_progress_of_a_stream(spark, tmp_path):
    import threading
    import time

    from contourlake.streaming import progress

    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/in")
    listener = progress.watch(spark, f"{tmp_path}/progress")
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        q = stream.writeStream.queryName("copy").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
        until = time.time() + 60
        while time.time() < until:
            rows = progress.progress(spark, f"{tmp_path}/progress").collect() if (tmp_path / "progress").exists() else []
            if any(r["event"] == "ended" for r in rows):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["rows"] or 0 for r in rows if r["event"] == "progress" and r["query"] == "copy") == 100
    assert {"started", "progress", "ended"} == {r["event"] for r in rows}
    seen = []
    job = threading.Thread(target=lambda: spark.range(0, 4_000_000, 1, 16).selectExpr("count_if(sha2(cast(id as string), 256) = 'x')").collect())
    job.start()
    while job.is_alive():
        seen += progress.running(spark)
        time.sleep(0.05)
    assert seen and all(0 <= share <= 1 and done <= tasks for *_, done, tasks, share in seen)


def test_tables_left(spark):
    """Of what an operator writes only what its result reads stays, and threads do not delete each other's tables."""
    import os
    import threading

    from contourlake.operators import neighbours
    from contourlake.operators.common import cut, shared_dir, temporary

    folder = f"{shared_dir(spark)}/contourlake"
    left = lambda: set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()
    v, e = tables(spark, {"a": ([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4], [(1, 2), (2, 3), (1, 4)])})
    points = spark.range(300).select(F.col("id").alias("conf_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    for f, most in ((lambda: contour.contour_arcs(v, e, 0.5), 2), (lambda: contour.critical_tree(v, e)[0], 2), (lambda: merge.merge_trees(v, e), 2), (lambda: neighbours.nearest(points, 3), 1), (lambda: neighbours.nearest_counted(points, 3, block=50)[0], 2)):
        before = left()
        assert f().count()
        assert len(left() - before) <= most, sorted(left() - before)
    held = []
    with temporary(spark):
        other = threading.Thread(target=lambda: held.append(cut(spark.range(3), "other")))
        other.start()
        other.join()
    assert held[0].count() == 3


def test_lanczos_over_tables(spark):
    """The largest eigenvalues and vectors of a small symmetric matrix, with a basis that has to begin again."""
    from contourlake.kernels import linalg as dense
    from contourlake.operators import linalg

    r = np.random.default_rng(2)
    n = 9
    m = np.where(r.random((n, n)) < 0.6, r.normal(size=(n, n)), 0)
    m = m + m.T + np.diag(np.arange(n) * 1.0)
    rows = [(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
    values, vectors = linalg.largest_eigenpairs(spark.createDataFrame(rows, "src long, dst long, w double"), 1, basis=6, tolerance=1e-6)
    want = np.linalg.eigvalsh(m)[::-1]
    x = np.zeros(n)
    for row in vectors.filter("j = 0").collect():
        x[row["v"]] = row["x"]
    assert abs(values[0] - want[0]) < 1e-6 and np.abs(m @ x - values[0] * x).max() < 1e-4
    assert np.abs(dense.lanczos(*np.nonzero(m), m[np.nonzero(m)], n, 3) - want[:3]).max() < 1e-9


def test_layouts_of_large_trees(spark):
    """The work of one task grows with the edges of a tree, not with their square."""
    import time

    from contourlake.operators import topology

    n = 40_000
    ids = spark.range(n)
    tree = ids.filter("id > 0").selectExpr("'all' AS key", "CAST(id AS int) AS edge_id", "(id - 1) DIV 2 AS n1", "id AS n2")
    vertices, areas = ids.selectExpr("'all' AS key", "id AS v", "CAST(id AS double) AS f"), tree.selectExpr("key", "edge_id", "1.0D AS area")
    start = time.perf_counter()
    rows = topology.space_partition(vertices, None, areas, None, tree).orderBy("sum_area").collect()
    assert len(rows) == n - 1 and rows[0].sum_area == 1 and rows[-1].sum_area == n - 1 and rows[-1].outer_v == n - 1
    assert time.perf_counter() - start < 60
