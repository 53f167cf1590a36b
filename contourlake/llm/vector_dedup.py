"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative for each group.

Equal vectors are one class from the start. Vectors of each length have cells of their own. Centres are fitted for each length on a bounded sample
(``SAMPLE`` classes chosen by hash); a class's home is the cell of its nearest centre. No link is lost at a border: a class also visits every cell whose
border (the plane halfway between the two centres) is within half the angle of the threshold. Of two classes in different homes whose angle is within the
threshold, the arc between them crosses that plane, so one of them is that near to it and meets the other at home. How many cells there are
is chosen by what the sample's visits would cost in copies and products, so unstructured vectors, which are near many borders, get few cells (never less than two) and others many.

A cell is cut into blocks of bounded size. Pairs of home blocks, and of a home block with a visiting block, are tasks of their own, so a cell with a third of
all rows is spread over many tasks and no task holds more than two blocks; a pair that meets in two cells counts in the first. A task
returns link counts and a spanning forest, never its pairs.

A link is a cosine of at least the threshold, computed in double precision. Vectors that are null, zero, or hold null or non-finite components, and rows with a
null id, link with nothing and are their own component. Rows with equal vectors all link with each other; repeated rows each keep a
row. Vectors of different lengths never link. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch
from .common import load, materialize, maybe_broadcast
from .graph import connected_components, least_reachable
from .vectors import bounded_sample, matrix, valid_vectors, width_of

#: Classes that k-means is fitted on, at most, and of these how many a cell needs.
SAMPLE, LEAST_ROWS = 65_536, 8
#: Classes of the sample whose visits are counted, at most.
TRIED = 4096
#: Classes of a block; a task holds two, and the cosines of ROWS of one with all of the other.
BLOCK, ROWS = 8192, 512
#: Numbers of a product's tile.
TILE = 1 << 22
#: What moving a vector to a task costs, in products of two vectors (measured: some 12 against 0.016 microseconds).
MOVE = 750.0


def _tiles(n: int, width: int):
    step = max(1, TILE // max(width, 1))
    return ((at, min(n, at + step)) for at in range(0, n, step))


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own = np.empty(len(x), np.int64)
    for a, b in _tiles(len(x), len(centres)):
        own[a:b] = np.argmax(x[a:b] @ centres.T, axis=1)
    return own


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of the unit rows x; a centre that loses all its rows keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centres(x, centres)
        sums = np.stack([np.bincount(own, column, len(centres)) for column in x.T], axis=1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, threshold: float):
    """Of unit rows, in tiles: (first row, homes, whether each row visits each cell)."""
    reach = np.sin(np.arccos(threshold) / 2) + 1e-9
    for a, b in _tiles(len(x), len(centres)):
        near = x[a:b] @ centres.T
        home = np.argmax(near, axis=1)
        apart = np.sqrt(np.maximum(((centres * centres).sum(1)[home])[:, None] + (centres * centres).sum(1) - 2 * centres[home] @ centres.T, 0))
        yield a, home, near[np.arange(b - a), home][:, None] - near <= reach * apart + 1e-12


def fit_cells(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Centres for n classes like those of the sample, two or more; the number of cells is the one of least cost."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    # Visits are counted on rows that the centres were not fitted on: those are nearer to their centres than others.
    order = np.random.default_rng(3).permutation(len(x))
    tried, x = np.split(x[order], [min(TRIED, len(x) // 4)])
    best, k = None, 2
    while k <= max(2, min(len(x) // LEAST_ROWS, 4 * int(np.sqrt(n)))):
        centres = spherical_kmeans(x, k)
        met = sum(v.sum() for *_, v in visits(tried, centres, threshold)) / max(len(tried), 1)
        home = n / k
        copies = met * np.ceil(home / BLOCK) + np.ceil(met * home / BLOCK)
        cost = n * copies * MOVE + n * met * home
        if best is None or cost < best[0]:
            best = cost, centres
        elif cost > 2 * best[0]:
            break
        k *= 4
    return best[1]


def _place(batches, centres: dict[int, np.ndarray], threshold: float, width: int):
    """centres: by bytes of a vector; vectors of any other length are in cell 0."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("home", pa.int32()), ("cells", pa.list_(pa.int32()))])
    for batch in batches:
        vecs, lengths = batch.column(2).to_pylist(), {}
        homes, cells = [0] * len(vecs), [[0]] * len(vecs)
        for i, v in enumerate(vecs):
            lengths.setdefault(len(v), []).append(i)
        for fit in (lengths[d] for d in lengths if d in centres):
            x = matrix((vecs[i] for i in fit), width)
            for first, home, met in visits(x / np.linalg.norm(x, axis=1, keepdims=True), centres[len(vecs[fit[0]])], threshold):
                for at, (h, row) in enumerate(zip(home.tolist(), met, strict=True), first):
                    homes[fit[at]], cells[fit[at]] = h, np.flatnonzero(row).tolist()
        yield record_batch([batch.column(0), batch.column(1), batch.column(2), homes, cells], schema)


def _compare(key, table: pa.Table, threshold: float, width: int) -> pa.Table:
    """One pair of blocks: (a, b, links): link counts (b null) and edges of a spanning forest (links null)."""
    _, cell, visiting, one, two = (k.as_py() for k in key)
    table = table.sort_by("id")
    ids, n, home, block = (table.column(c).to_numpy() for c in ("id", "n", "home", "block"))
    x = matrix(table.column("vec").to_pylist(), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at_home = home == cell
    left = np.flatnonzero(at_home & (block == one))
    right = np.flatnonzero(~at_home & (block == two)) if visiting else np.flatnonzero(at_home & (block == two))
    earlier, which = None, None
    if visiting:
        # A pair that also meets at the visitor's home counts there if that cell comes first.
        others, which = np.unique(home[right], return_inverse=True)
        lists = table.column("cells").to_pylist()
        sizes = [len(lists[i]) for i in left]
        flat = np.fromiter((c for i in left for c in lists[i]), np.int64, sum(sizes))
        row, place = np.repeat(np.arange(len(left)), sizes), np.searchsorted(others, flat)
        hit = (place < len(others)) & (others[np.minimum(place, len(others) - 1)] == flat) & (flat < cell) if len(others) else np.zeros(len(flat), bool)
        earlier = np.zeros((len(left), len(others)), bool)
        earlier[row[hit], place[hit]] = True
    counts, forest = np.zeros(len(ids)), []
    for at in range(0, len(left), ROWS):
        i, j = np.divmod(np.flatnonzero(x[left[at : at + ROWS]] @ x[right].T >= threshold), max(len(right), 1))
        if visiting:
            new = ~earlier[at + i, which[j]]
        else:
            new = left[at + i] != right[j] if one == two else np.ones(len(i), bool)
        i, j = left[at + i[new]], right[j[new]]
        counts += np.bincount(i, n[j], len(ids))
        if visiting or one != two:
            counts += np.bincount(j, n[i], len(ids))
        # Of each part only a forest is kept.
        low = least_reachable(i, j, len(ids))
        hung = np.flatnonzero(low != np.arange(len(ids)))
        forest.append((low[hung], hung))
    a, b = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*forest, strict=True)) if forest else (np.zeros(0, np.int64),) * 2
    low = least_reachable(a, b, len(ids))
    hung = np.flatnonzero(low != np.arange(len(ids)))
    told = np.flatnonzero(counts)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    return pa.table([pa.array(np.concatenate([ids[told], ids[hung]])), pa.array([None] * len(told) + ids[low[hung]].tolist(), pa.int64()), pa.array(counts[told].astype(np.int64).tolist() + [None] * len(hung), pa.int64())], schema=schema)


def near_duplicates(df: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """df(key bigint, column array) -> key, n_links, component_id, kept; one row for each input row."""
    width = width_of(df, column)
    vectors = materialize(valid_vectors(df, key, column).withColumn("h", F.unhex(F.md5("vec"))), "vectors")
    classes = materialize(vectors.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "classes")
    length = F.octet_length("vec")
    centres = {}
    for d, n in classes.groupBy(length.alias("d")).count().filter("count > 1").orderBy("d").collect():
        centres[d] = fit_cells(bounded_sample(classes.filter(length == d), n, SAMPLE, width), n, threshold)
    place = partial(_place, centres=centres, threshold=threshold, width=width)
    placed = materialize(map_batches(classes.select("id", "n", "vec"), place, "id long, n long, vec binary, home int, cells array<int>"), "cells")
    placed = placed.withColumn("d", length)
    met = placed.withColumn("cell", F.explode("cells"))
    # A row for each cell: the blocks of its own classes and of its visitors.
    parts = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    blocks = materialize(met.groupBy("d", "cell").agg(parts(F.col("cell") == F.col("home")).alias("own"), parts(F.col("cell") != F.col("home")).alias("guests")).filter("own > 0"), "blocks")
    met = met.join(maybe_broadcast(blocks), ["d", "cell"])
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    columns = ["d", "cell", "visiting", "one", "two", "id", "n", "vec", "home", "cells", "block"]
    none = F.lit(None).cast("array<int>").alias("cells")
    own = met.filter("cell = home").withColumn("block", deal("own"))
    among = own.withColumn("other", F.explode(upto("own"))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).withColumn("visiting", F.lit(False))
    hosts = own.filter("guests > 0").withColumn("two", F.explode(upto("guests"))).withColumn("one", F.col("block")).withColumn("visiting", F.lit(True))
    guests = met.filter("cell <> home").withColumn("block", deal("guests")).withColumn("one", F.explode(upto("own"))).withColumn("two", F.col("block")).withColumn("visiting", F.lit(True))
    light = lambda rows: rows.withColumn("cells", none).select(*columns)
    tasks = light(among).unionByName(hosts.select(*columns)).unionByName(light(guests))
    compare = partial(_compare, threshold=threshold, width=width)
    found = materialize(tasks.groupBy("d", "cell", "visiting", "one", "two").applyInArrow(lambda key, rows: compare(key, rows), "a long, b long, links long"), "links")
    links = found.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    known = (
        classes.select("h", "id", "n").join(links.withColumnRenamed("a", "id"), "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
        .select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    rows = vectors.select(F.col("id"), "h").join(known, "h").select(F.col("id").alias(key), "n_links", "component_id")
    # What takes no part: a row for each of its rows.
    values = F.col(column).cast("array<double>")
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    takes = F.col(key).isNotNull() & values.isNotNull() & whole & F.exists(values, lambda v: v != 0)
    rest = df.filter(~F.coalesce(takes, F.lit(False))).select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
r(v, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v WHERE r.root < l.b),
m AS (SELECT v, min(root) AS root FROM r GROUP BY 1),
c AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, m.root AS component_id, v.vec_id = m.root AS kept FROM v JOIN m ON m.v = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
