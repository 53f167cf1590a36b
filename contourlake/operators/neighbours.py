"""Exact nearest neighbours and the graph made of them."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, numbered, small, temporary
from .graph import connected_components

#: Rows of a block, at least and at most; between, a table has about ``BLOCKS`` of them.
BLOCK, MOST, BLOCKS = 2048, 16384, 24
#: Blocks' rows, about, that stand on either side of a task.
TOGETHER = 4
#: Cells, at most, whose pivots every task knows.
PIVOTS = 4096
#: Rows of a block that are compared at a time, and with how many: inside it, and of other blocks.
TILE, CHUNK, SPAN = 256, 4096, 1024
#: Pairs for each row, about, that wait until they are merged.
WAIT = 4
#: Pairs whose distances are computed at a time.
PAIRS = 1 << 9
#: Segments by which distances are bounded from below, coarse to fine.
SEGMENTS = (1, 4, 16)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def segment_sketches(x: np.ndarray) -> list[np.ndarray]:
    """For each number of segments, features whose squared distance is at most that of the vectors: of a segment of length l, sqrt(l) times its mean and its deviation."""
    out = []
    for segments in SEGMENTS:
        cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
        parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append(np.concatenate([np.stack([p.mean(axis=1), p.std(axis=1)], axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1))
    return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances, folded in the order of components, as the SQL form does."""
    d2 = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        step = x[:, j][:, None] - y[:, j][None]
        d2 += step * step
    return d2


def _of_pairs(x, y, rows, columns):
    """Squared distances of some pairs, folded as in :func:`_squared`."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS):
        step = x[rows[at : at + PAIRS]] - y[columns[at : at + PAIRS]]
        step *= step
        part = out[at : at + PAIRS]
        for c in range(step.shape[1]):
            part += step[:, c]
    return out


class _Chunk:
    """Candidates that are compared at a time: single-precision features, and a ball and a box of sketches around them."""

    def __init__(self, y, ids, scaled, margin):
        self.y, self.ids = y, ids
        half = (scaled * scaled).sum(1) * (0.5 - margin)
        self.features = np.concatenate([scaled, -half[:, None]], axis=1).astype(np.float32).T.copy()
        self.centre = scaled.mean(axis=0)
        self.radius = np.sqrt(((scaled - self.centre) ** 2).sum(1).max())
        sketch = segment_sketches(scaled)[-1]
        self.low, self.high = sketch.min(axis=0), sketch.max(axis=0)

    def reached(self, x, sketch, bound):
        """Which rows can have a candidate within their bound."""
        far = np.sqrt(((x - self.centre) ** 2).sum(1)) - self.radius
        box = np.maximum(np.maximum(self.low - sketch, sketch - self.high), 0)
        return np.maximum(far, np.sqrt((box * box).sum(1))) <= np.sqrt(bound) * (1 + 1e-9) + 1e-9


def _merged(held, found, k, n):
    """(row, id, squared distance) of the k least of each of n rows, ties to the smaller id, and each row's k-th distance (infinity without one)."""
    i, j, d = (np.concatenate(c) for c in zip(held, found, strict=True))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(n + 1))
    near = np.arange(len(i)) - first[i] < k
    kth = np.full(n, np.inf)
    full = np.diff(first) >= k
    kth[full] = d[first[:-1][full] + k - 1]
    return (i[near], j[near], d[near]), kth


def _search(x, ids, bound, y, others, k):
    """(src, dst, squared distance, how many distances were computed): of each row of x the k nearest rows of y within its bound, itself excluded.

    A product of matrices in single precision decides which pairs can be within a row's bound, which falls as nearer rows are found; only their distances are computed. With u = 2^-24 and d components, inputs'
    rounding and a sum in any order leave the product (and the half square that is one more component) within (d + 4) u (|x|^2 / 2 + |y|^2) of its value; the margins are more than twice that. All is centred and
    scaled to at most 1 first, so what underflows is below 1e-37.
    """
    centre = y.mean(axis=0)
    sx, sy = x - centre, y - centre
    most = max(np.abs(sx).max(), np.abs(sy).max())
    scale = 2.0 ** -np.ceil(np.log2(most)) if most > 0 else 1.0
    sx, sy = sx * scale, sy * scale
    margin = (x.shape[1] + 16) * 2.0**-23
    chunks = [_Chunk(y[a : a + CHUNK], others[a : a + CHUNK], sy[a : a + CHUNK], margin) for a in range(0, len(y), CHUNK)]
    sketches, half = segment_sketches(sx)[-1], (sx * sx).sum(1) * (0.5 - margin)
    features = np.concatenate([sx, np.ones((len(x), 1))], axis=1).astype(np.float32)
    out, computed = [], 0
    for at in range(0, len(x), TILE):
        tile = slice(at, min(at + TILE, len(x)))
        own, names, least, held = x[tile], ids[tile], bound[tile].copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        middle = sx[tile].mean(axis=0)
        for chunk in sorted(chunks, key=lambda c: ((c.centre - middle) ** 2).sum()):
            active = np.flatnonzero(chunk.reached(sx[tile], sketches[tile], least * scale * scale))
            if not len(active):
                continue
            product = features[tile][active] @ chunk.features
            if np.isinf(least[active]).any() and product.shape[1] > k + 1:
                # Any k others bound the k-th distance; the row itself may be one more.
                some = np.argpartition(product, -k - 1, axis=1)[:, -k - 1 :]
                d2 = _of_pairs(own, chunk.y, np.repeat(active, k + 1), some.ravel()).reshape(some.shape)
                computed += d2.size
                d2[names[active][:, None] == chunk.ids[some]] = np.inf
                least[active] = np.minimum(least[active], np.partition(d2, k - 1, axis=1)[:, k - 1])
            edge = np.nextafter((half[tile][active] - least[active] * (scale * scale / 2) - 1e-37).astype(np.float32), np.float32(-np.inf))
            # Most rows have nothing within their bound: their largest product tells.
            hit = np.flatnonzero(product.max(axis=1) >= edge)
            if not len(hit):
                continue
            i, j = np.divmod(np.flatnonzero(product[hit] >= edge[hit][:, None]), product.shape[1])
            i = active[hit[i]]
            computed += len(i)
            d2 = _of_pairs(own, chunk.y, i, j)
            keep = np.isfinite(d2) & (d2 <= least[i]) & (names[i] != chunk.ids[j])
            held, kth = _merged(held, (i[keep], chunk.ids[j[keep]], d2[keep]), k, len(own))
            least = np.minimum(least, kth)
        out.append((names[held[0]], held[1], held[2]))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), computed


NEAR = "src long, dst long, d2 double"


class _Side:
    """Some rows of one block in one side of a comparison: scaled vectors, a ball and a box of sketches around them, and the k nearest found so far of each within its bound."""

    def __init__(self, x, ids, bound, scaled, margin, k):
        self.x, self.ids, self.least, self.k = x, ids, bound.copy(), k
        self.scaled, self.half = scaled, (scaled * scaled).sum(1) * (0.5 - margin)
        self.sketch = segment_sketches(scaled)[-1]
        self.low, self.high = self.sketch.min(axis=0), self.sketch.max(axis=0)
        self.centre = scaled.mean(axis=0)
        self.radius = np.sqrt(((scaled - self.centre) ** 2).sum(1).max())
        self.held, self.waiting, self.n_waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        self.close = None

    def features(self, first):
        """Single-precision features whose product with those of another side (one of them ``first``) is at least -d2 / 2."""
        one, half = np.ones((len(self.x), 1)), -self.half[:, None]
        return np.concatenate([self.scaled, *((one, half) if first else (half, one))], axis=1).astype(np.float32)

    def edge(self, scale):
        """The least product of a pair within each row's bound."""
        if self.close is None:
            self.close = np.nextafter((-self.least * (scale * scale / 2) - 1e-37).astype(np.float32), np.float32(-np.inf))
        return self.close

    def reached(self, far, other, scale):
        """Which rows can be within their own bound, or within that of a row of the other side, of the other side; ``far``: distances from its centre."""
        most = np.sqrt(np.maximum(self.least, other.least.max())) * scale * (1 + 1e-9) + 1e-9
        rows = np.flatnonzero(far - other.radius <= most)
        if len(rows):
            sketch = self.sketch if len(rows) == len(self.x) else self.sketch[rows]
            box = np.maximum(np.maximum(other.low - sketch, sketch - other.high), 0)
            rows = rows[np.sqrt((box * box).sum(1)) <= most[rows]]
        return rows

    def found(self, rows, ids, d2):
        keep = np.isfinite(d2) & (d2 <= self.least[rows]) & (self.ids[rows] != ids)
        self.waiting.append((rows[keep], ids[keep], d2[keep]))
        self.n_waiting += int(keep.sum())
        if self.n_waiting > WAIT * len(self.x):
            self.merge()

    def merge(self):
        if self.n_waiting:
            found = tuple(np.concatenate(c) for c in zip(*self.waiting, strict=True))
            self.held, kth = _merged(self.held, found, self.k, len(self.x))
            self.least = np.minimum(self.least, kth)
            self.close = None
        self.waiting, self.n_waiting = [], 0

    def result(self):
        self.merge()
        return self.ids[self.held[0]], self.held[1], self.held[2]


def _where(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a contiguous mask, eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _search_both(x, ids, bound, block, second, k):
    """(src, dst, squared distance, how many distances were computed): the k nearest, within each row's bound, among the rows of other blocks.

    Rows are in the order of their blocks. Those not in ``second`` meet those in it; where ``second`` is empty, every two blocks meet, and a row has k of the blocks before its own and k of those after it. One product of matrices serves both rows of a pair: with two more components, the
    half squares of both, it is -d2 / 2, and what is said of rounding in :func:`_search` holds with a term more.
    """
    centre = x.mean(axis=0)
    scaled = x - centre
    most = np.abs(scaled).max()
    scale = 2.0 ** -np.ceil(np.log2(most)) if most > 0 else 1.0
    scaled, margin = scaled * scale, (x.shape[1] + 16) * 2.0**-23
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
    spans = list(zip(starts, [*starts[1:], len(x)], strict=True))
    side = lambda a, b: _Side(x[a:b], ids[a:b], bound[a:b], scaled[a:b], margin, k)
    chunks = []
    for n, (start, stop) in enumerate(spans):
        if second[start] or not second.any():
            for a in range(start, stop, SPAN):
                chunk = side(a, min(a + SPAN, stop))
                chunks.append((n, chunk, chunk.features(False).T.copy()))
    centres = np.stack([c.centre for _, c, _ in chunks])
    centre2 = (centres * centres).sum(1)
    out, computed = [], 0
    space, masks = np.empty(TILE * SPAN, np.float32), np.empty((2, TILE * SPAN), bool)
    for n, (start, stop) in enumerate(spans):
        if second[start]:
            continue
        for a in range(start, stop, TILE):
            tile = side(a, min(a + TILE, stop))
            features, square = tile.features(True), (tile.scaled * tile.scaled).sum(1)[:, None] + centre2
            far = np.sqrt(np.maximum(square * (1 - (x.shape[1] + 16) * 2.0**-50) - 2 * (tile.scaled @ centres.T), 0))
            for c in np.argsort(far.sum(axis=0)).tolist():
                at, chunk, other = chunks[c]
                if at <= n:
                    continue
                active = tile.reached(far[:, c], chunk, scale)
                if not len(active):
                    continue
                shape = len(active), other.shape[1]
                product, one, two = (z[: shape[0] * shape[1]].reshape(shape) for z in (space, *masks))
                np.matmul(features if len(active) == len(features) else features[active], other, out=product)
                np.greater_equal(product, tile.edge(scale)[active][:, None], out=one)
                np.greater_equal(product, chunk.edge(scale), out=two)
                i, j = np.divmod(_where(np.logical_or(one, two, out=one)), shape[1])
                if len(i):
                    i = active[i]
                    d2 = _of_pairs(tile.x, chunk.x, i, j)
                    computed += len(d2)
                    tile.found(i, chunk.ids[j], d2)
                    chunk.found(j, tile.ids[i], d2)
            out.append(tile.result())
    out += [chunk.result() for _, chunk, _ in chunks]
    return *(np.concatenate(c) for c in zip(*out, strict=True)), computed


def _near_table(src, dst, d, computed) -> pa.Table:
    """Rows of NEAR; the one without src tells how many distances were computed."""
    ends = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(1, pa.int64())]) for c in (src, dst)]
    return pa.table({"src": ends[0], "dst": ends[1], "d2": pa.array(np.append(d, float(computed)), pa.float64())})


def _inside(table: pa.Table, k: int) -> pa.Table:
    """The k nearest of each row of a block inside it."""
    table = table.sort_by([("r", "ascending"), ("id", "ascending")])
    x = _matrix(table.column("v"))
    # What is not finite is near nothing.
    use = np.isfinite(x).all(axis=1)
    if not use.any():
        return _near_table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
    x, ids = x[use], table.column("id").to_numpy()[use]
    return _near_table(*_search(x, ids, np.full(len(x), np.inf), x, ids, k))


def _between(table: pa.Table, k: int) -> pa.Table:
    """The k nearest of each row in the other blocks of the task, if they are within its bound."""
    table = table.sort_by([("second", "ascending"), ("block", "ascending"), ("r", "ascending"), ("id", "ascending")])
    x = _matrix(table.column("v"))
    use = np.isfinite(x).all(axis=1)
    if not use.any():
        return _near_table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
    ids, bound, block, second = (table.column(c).to_numpy()[use] for c in ("id", "bound", "block", "second"))
    return _near_table(*_search_both(x[use], ids, bound, block, second, k))


def _assign(batches, pivots: np.ndarray):
    """(id, v, cell, r): the nearest pivot and the distance from it."""
    for batch in batches:
        x = _matrix(batch.column(1))
        if not len(x):
            continue
        r = np.sqrt(_squared(x, pivots))
        cell = r.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(r[np.arange(len(x)), cell])], names=["id", "v", "cell", "r"])


def _reached(batches, pivots: np.ndarray, radii: np.ndarray):
    """(block, cell, gap): the cells that can hold something within the bound of a block, and the distance of the pivots."""
    for batch in batches:
        block, cell, far, bound = (batch.column(c).to_numpy() for c in range(4))
        apart = np.sqrt(_squared(pivots[cell], pivots))
        i, j = np.nonzero(apart - far[:, None] - radii <= bound[:, None] + 1e-9 * (1 + apart))
        yield pa.RecordBatch.from_arrays([pa.array(block[i]), pa.array(j, pa.int64()), pa.array(apart[i, j])], names=["block", "cell", "gap"])


def nearest_counted(points: DataFrame, k: int, key: str = "conf_id", vector: str = "v", block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((src, dst, rank, d2), one row with the number of distances computed): the k nearest others of each, by squared distance, then id. Exact.

    Rows go to the cell of the nearest of a bounded number of pivots, and in the order of their distance from it to blocks of bounded size. A block first finds the k nearest inside it, which bounds each row's k-th
    distance. By the triangle inequality a block meets another only if the gap of their pivots, less how far their rows are from them, is within the largest bound of either. A task compares some blocks with some
    others, every two once for the rows of both, so its size is bounded and it returns 2 k rows at most for each of theirs; of chunks of rows that meet, a product of matrices in single precision with a margin bounds
    distances from below, and only pairs that can be within the bound are computed. Vectors without structure leave a product for all pairs, halved.
    """
    with temporary(points.sparkSession) as keep:
        return _nearest(points, k, key, vector, block, keep)


def _nearest(points: DataFrame, k: int, key: str, vector: str, block: int | None, keep) -> tuple[DataFrame, DataFrame]:
    wide = dict(points.dtypes)[vector] != "array<float>"
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = cut(rows, "points")
    n = rows.count()
    block = block or max(BLOCK, min(MOST, -(-n // BLOCKS)))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))

    def both(found):
        ranked = found.filter("src IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", "rank", "d2")
        told = found.filter("src IS NULL").agg(F.sum("d2").alias("d2")).select(F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("int").alias("rank"), "d2")
        near = keep(ranked.unionByName(told), "near")
        return near.filter("src IS NOT NULL"), near.filter("src IS NULL").select(F.col("d2").alias("computed"))

    inside = lambda df: df.select("id", "v", "block", "r").groupBy("block").applyInArrow(lambda key, t: _inside(t, k), NEAR)
    if n <= block:
        return both(inside(rows.withColumns({"block": F.lit(0).cast("long"), "r": F.lit(0.0)})))
    # A bounded sample.
    sample = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(min(PIVOTS, -(-n // block))).select("v").toArrow()
    pivots = _matrix(sample.column("v"))
    placed = rows.mapInArrow(partial(_assign, pivots=pivots), f"id long, v {dict(rows.dtypes)['v']}, cell long, r double")
    placed = numbered(placed, [F.col("cell"), F.col("r"), F.col("id")], "place", kind="long")
    placed = cut(placed.withColumn("block", F.col("cell") * (1 << 40) + F.floor(F.col("place") / block)).drop("place"), "placed")
    home = cut(inside(placed), "home")
    kth = home.filter("src IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("bound"))
    placed = cut(placed.join(kth, "id", "left").fillna({"bound": float("inf")}), "bounded")
    blocks = placed.groupBy("block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("far"), F.sqrt(F.max("bound")).alias("reach"), F.count(F.lit(1)).alias("n"))
    # Blocks in their order are dealt to groups of about so many rows. A row for each block.
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = cut(blocks.withColumn("pack", F.floor(F.coalesce(before, F.lit(0)) / (TOGETHER * block))).drop("n"), "blocks")
    # A row for each cell, at most PIVOTS.
    radii = np.zeros(len(pivots))
    for cell, far in blocks.groupBy("cell").agg(F.max("far")).collect():
        radii[cell] = far
    met = blocks.select("block", "cell", "far", "reach").mapInArrow(partial(_reached, pivots=pivots, radii=radii), "block long, cell long, gap double")
    own = blocks.select("block", F.col("pack").alias("own_pack"), F.col("far").alias("own_far"), "reach")
    other = small(blocks.select("cell", F.col("block").alias("other"), "pack", "low", "far"))
    slack = F.lit(1e-9) * (1 + F.col("gap"))
    near = (F.col("gap") - F.col("own_far") - F.col("far") <= F.col("reach") + slack) & (F.col("low") - F.col("gap") - F.col("own_far") <= F.col("reach") + slack)
    # A pair of groups is a task; of each only the blocks that meet one of the other. Groups keep the order of blocks, and so do the sides.
    pairs = met.join(small(own), "block").join(other, "cell").filter((F.col("block") != F.col("other")) & near)
    ends = lambda block, pack: F.struct(F.col(block).alias("block"), F.col(pack).alias("pack"))
    ends = [f(ends("block", "own_pack"), ends("other", "pack")) for f in (F.least, F.greatest)]
    pairs = cut(pairs.select(ends[0].alias("a"), ends[1].alias("b")).distinct().select(F.col("a.pack").alias("one"), F.col("b.pack").alias("two"), F.col("a.block").alias("block"), F.col("b.block").alias("other")), "pairs")
    sides = pairs.select("one", "two", "block", F.lit(False).alias("second")).unionByName(pairs.select("one", "two", F.col("other").alias("block"), (F.col("one") != F.col("two")).alias("second"))).distinct()
    tasks = placed.select("id", "v", "block", "r", "bound").join(small(sides), "block")
    across = cut(tasks.groupBy("one", "two").applyInArrow(lambda key, t: _between(t, k), NEAR), "across")
    return both(home.unionByName(across))


def nearest(points: DataFrame, k: int, key: str = "conf_id", vector: str = "v") -> DataFrame:
    """points(key, vector) -> src, dst, rank, d2: :func:`nearest_counted` without the count."""
    return nearest_counted(points, k, key, vector)[0]


def undirected(neighbours: DataFrame) -> DataFrame:
    """src, dst with src < dst, each edge once; loops go."""
    return neighbours.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """v, w in both directions."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("w")))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(v), edges(src, dst) -> v, component: the least vertex reachable. Vertices that are no numbers are numbered in their order first."""
    if dict(vertices.dtypes)["v"] not in ("bigint", "int"):
        names = cut(numbered(vertices.select("v").distinct(), [F.col("v")], "n", kind="long"), "names")
        ends = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = components(names.select(F.col("n").alias("v")), ends).toDF("n", "c")
        return found.join(names, "n").join(names.toDF("component", "c"), "c").select("v", "component")
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices.join(found, F.col("v") == F.col("node"), "left").select("v", F.coalesce(F.col("component").cast(dict(vertices.dtypes)["v"]), F.col("v")).alias("component"))


def sample_map(paths: DataFrame, names: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """paths(conf_id, path) -> s_id, conf_id: the rows on the list (or not on it), numbered from 0 by conf_id; all without a list.

    Numbering is by range partitions: counts of each, then places inside, so no task sees all rows.
    """
    if names is not None:
        paths = paths.join(small(names.select("path").distinct()), "path", "left_semi" if keep else "left_anti")
    return numbered(paths.select("conf_id"), [F.col("conf_id")], "s_id").select("s_id", "conf_id")


def build_domain(points: DataFrame, k: int, paths: DataFrame | None = None, names: DataFrame | None = None, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst) over s_id, sample_map) of the listed structures that have a point; raises if the graph is not connected."""
    if k < 2:
        raise ValueError("k must be at least 2")
    listed = points.select("conf_id") if paths is None else paths.join(points.select("conf_id"), "conf_id", "left_semi")
    sample = cut(sample_map(listed, names, keep), "sample_map")
    own = points.join(sample, "conf_id").select("s_id", "v")
    edges = cut(undirected(nearest(own, k, "s_id")).select(F.col("src").cast("int"), F.col("dst").cast("int")), "edges")
    parts = components(sample.select(F.col("s_id").alias("v")), edges).select("component").distinct().count()
    if parts > 1:
        raise ValueError(f"the graph has {parts} components; choose a larger k")
    return edges, sample


def vertex_pairs(edges: DataFrame, values: DataFrame) -> DataFrame:
    """v, w, fv, fw over both directions; values(v, f)."""
    v = values.select("v", F.col("f").alias("fv"))
    w = values.select(F.col("v").alias("w"), F.col("f").alias("fw"))
    return adjacency(edges).join(v, "v").join(w, "w")


def is_higher(f1, v1, f2, v2):
    """(f1, v1) above (f2, v2) in the total order."""
    return (f1 > f2) | ((f1 == f2) & (v1 > v2))


def steepest(edges: DataFrame, values: DataFrame, points: DataFrame, up: bool = True) -> DataFrame:
    """v, target: the higher (or lower) neighbour of the largest gradient; of ties the largest id; the vertex itself if there is none."""
    from ..functions.columns import gradient, squared_distance

    pairs = vertex_pairs(edges, values)
    higher = is_higher(F.col("fw"), F.col("w"), F.col("fv"), F.col("v"))
    pairs = pairs.filter(higher if up else ~higher)
    a, b = points.select("v", F.col("p").alias("pv")), points.select(F.col("v").alias("w"), F.col("p").alias("pw"))
    slope = gradient(F.col("fv").cast("double"), F.col("fw").cast("double"), F.sqrt(squared_distance(F.col("pv"), F.col("pw"))))
    best = pairs.join(a, "v").join(b, "w").groupBy("v").agg(F.max(F.struct(slope.alias("slope"), "w")).alias("best"))
    return values.select("v").join(best, "v", "left").select("v", F.coalesce("best.w", "v").alias("target"))


def vertex_classes(edges: DataFrame, values: DataFrame) -> DataFrame:
    """v, up, down, class by higher and lower neighbours."""
    pairs = vertex_pairs(edges, values)
    higher = is_higher(F.col("fw"), F.col("w"), F.col("fv"), F.col("v"))
    counts = pairs.groupBy("v").agg(F.count_if(higher).alias("up"), F.count_if(~higher).alias("down"))
    every = values.select("v").join(counts, "v", "left").select("v", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))
    return every.withColumn("node_class", node_class(F.col("up"), F.col("down")))


def node_class(up, down):
    return (
        F.when((up == 1) & (down == 1), "ordinary")
        .when((up == 0) & (down == 1), "max")
        .when((down == 0) & (up == 1), "min")
        .when((up == 0) | (down == 0), "other")
        .when(down == 1, "branch_up")
        .when(up == 1, "branch_down")
        .otherwise("multibranch")
    )
