"""Approximate nearest neighbours over shifted Hilbert orderings.

For each of ``curves`` orderings, vectors are projected on a few random orthonormal directions, each coordinate is mapped to its share
of a bounded sample below it, shifted, and put on a grid; the Hilbert index of the grid cell is the key. Rows are range-partitioned by (curve, key),
so their rank on a curve is a partition's offset plus the place in it. Vectors of each length have orderings and ranks of their own; where all of a length
are within reach of each other, one ordering does. A query meets the rows within ``window`` of all ranks around its own
on every curve. What travels along the curves is a sketch: a byte for each component, with a bound of the error. Chunks of ranks of bounded size are compared by
sketches, which gives bounds of every distance; rows whose lower bound is above the k-th smallest upper bound go, the windows of all curves are merged, and
the few that are left meet the original vectors in a join. So within the windows nothing is lost.

The window is a share of the table, alike at every size. Vectors without any structure need a large one for a recall of 0.9: sketches compared are then as many
as in a search of everything (see the README's figures); for vectors with structure a smaller one does. ``window=1.0`` compares all with all, on one curve: the exact search.

Of equal vectors only the k + 1 smallest ids are candidates: no other can be among the k nearest of any query. So a vector that a third of all rows share
takes no more ranks than others do. All rows are indexed and any may ask.

Nearness is Euclidean distance in double precision, ties to the smaller id. Vectors that are null, zero, or hold null or non-finite components, rows with a
null id take no part, and vectors of different lengths are no neighbours. Rows that repeat an id are one candidate, at the nearest of its distances. An
empty table or one without queries gives no rows; a query without candidates gives none. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import map_batches, record_batch
from .common import load, materialize, maybe_broadcast
from .vectors import bounded_sample, matrix, valid_vectors, width_of

#: Vectors that coordinates are scaled by, at most.
SAMPLE = 10_000
CURVES, DIRECTIONS, BITS = 16, 6, 10
#: Ranks on either side of a query, as a share of all.
WINDOW = 0.05
CHUNK = 4096
QUERIES_A_TASK = 2048


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of grid cells (n, m) on the m-dimensional Hilbert curve of 2**bits cells a side; bits * m <= 63.

    Works on the transposed index (Skilling, "Programming the Hilbert curve", 2004), then interleaves.
    """
    x = cells.astype(np.int64).T.copy()
    m = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            on = (axis >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(on, low, swap)
            if axis is not x[0]:
                axis ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= fix
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> bit & 1)
    return key


def fit_curves(sample: np.ndarray, curves: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turns, scales, shifts) of the orderings of vectors like those of the sample."""
    d = sample.shape[1]
    rng, m = np.random.default_rng(seed), min(DIRECTIONS, d)
    turns = np.stack([np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m] for _ in range(curves)])
    shifts = rng.random((curves, m))
    scales = np.stack([np.quantile(sample @ t, np.linspace(0, 1, 513), axis=0).T for t in turns])
    return turns, scales + np.arange(513) * 1e-12, shifts  # ascending where the sample repeats itself


def sketches(x: np.ndarray) -> list[bytes]:
    """scale, bound of the distance to the vector, a signed byte for each component."""
    scale = np.abs(x).max(axis=1) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    # The last term covers rounding in products of sketches.
    off = np.sqrt(((x - small * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-7 * np.sqrt((x * x).sum(1))
    head = np.stack([scale, off], axis=1)
    return [h.tobytes() + v.tobytes() for h, v in zip(head, small, strict=True)]


def read_sketches(data) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, bounds)."""
    data = list(data)
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    head = np.ascontiguousarray(raw[:, :16]).view(np.float64)
    return np.ascontiguousarray(raw[:, 16:]).view(np.int8) * head[:, :1], head[:, 1]


def _keys(batches, fits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], width: int):
    """(d, curve, key, id, query, offered, sketch) of every vector on every curve of its length; those of a length without a fit are on one."""
    schema = pa.schema([("d", pa.int32()), ("curve", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("query", pa.bool_()), ("offered", pa.bool_()), ("sketch", pa.binary())])
    for batch in batches:
        lengths: dict[int, list[int]] = {}
        for i, v in enumerate(batch.column(3).to_pylist()):
            lengths.setdefault(len(v) // width, []).append(i)
        for d, members in lengths.items():
            part = batch.take(pa.array(members))
            x = matrix(part.column(3).to_pylist(), width)
            rest = [*(part.column(i) for i in range(3)), pa.array(sketches(x), pa.binary())]
            name = np.full(len(members), d, np.int32)
            if d not in fits:
                yield record_batch([name, np.zeros(len(members), np.int32), np.zeros(len(members), np.int64), *rest], schema)
                continue
            turns, scales, shifts = fits[d]
            shares = np.linspace(0, 1, scales.shape[-1])
            for c in range(len(turns)):
                y = x @ turns[c]
                u = np.stack([np.interp(y[:, j], scales[c, j], shares) for j in range(y.shape[1])], axis=1)
                cells = np.minimum(((u + shifts[c]) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                yield record_batch([name, np.full(len(members), c, np.int32), hilbert_index(cells, BITS), *rest], schema)


def _nearest(table: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, low, high): of a chunk's rows within a query's reach those that can be among its k nearest, with bounds of their distance."""
    asks = table.column("asks")
    rows, queries = table.filter(pc.invert(asks)), table.filter(asks)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    (x, off), (q, missed) = read_sketches(rows.column("sketch").to_pylist()), read_sketches(queries.column("sketch").to_pylist())
    ids, ranks = rows.column("id").to_numpy(), rows.column("rank").to_numpy()
    about = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
    out = []
    for i, (own, rank, reach) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("id", "rank", "reach")), strict=True)):
        near = np.flatnonzero((ids != own) & (np.abs(ranks - rank) <= reach))
        low, high = about[i, near] - off[near] - missed[i], about[i, near] + off[near] + missed[i]
        # Rows of one id count once: k rows may be fewer ids.
        if len(near) > k:
            order = np.argsort(high, kind="stable")
            _, firsts = np.unique(ids[near][order], return_index=True)
            if len(firsts) > k:
                fit = low <= high[order][np.partition(firsts, k - 1)[k - 1]]
                near, low, high = near[fit], low[fit], high[fit]
        out.append((np.full(len(near), own), ids[near], low, high))
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _distances(batches, width: int):
    """(query_id, vec_id, q, v) -> query_id, vec_id, score."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    for batch in batches:
        q, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        score = np.zeros(len(q))
        sizes = np.array([len(x) for x in q], np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            score[at] = np.sqrt(((matrix((v[i] for i in at), width) - matrix((q[i] for i in at), width)) ** 2).sum(1))
        yield record_batch([batch.column(0), batch.column(1), score], schema)


def nearest_neighbours(
    df: DataFrame, queries: Column, key: str = "vec_id", column: str = "embedding", k: int = 10, curves: int = CURVES, window: float = WINDOW, seed: int = 5
) -> DataFrame:
    """df(key bigint, column array); ``queries``: a condition on ``id`` -> query_id, rank (from 1), vec_id, score."""
    width = width_of(df, column)
    vectors = valid_vectors(df, key, column).distinct().withColumn("h", F.md5("vec")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    # The smallest ids of a vector, first of each salt, then of these.
    place = F.dense_rank().over(Window.partitionBy("h", "salt").orderBy("id"))
    vectors = vectors.withColumn("first", place <= k + 1)
    place = F.dense_rank().over(Window.partitionBy("h", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("salt"))).orderBy("id"))
    vectors = materialize(vectors.select("id", F.coalesce(queries, F.lit(False)).alias("query"), (F.col("first") & (place <= k + 1)).alias("offered"), "vec").filter("query OR offered"), "vectors")
    # Of each length: rows, queries, ranks on either side that a query meets, parts that its queries are dealt to.
    sizes = vectors.groupBy((F.octet_length("vec") / width).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("queries"))
    sizes = sizes.withColumn("reach", F.greatest(F.ceil(F.col("n") * window), F.lit(4 * k).cast("long")))
    share = (2 * F.col("reach") + CHUNK) * F.greatest("queries", F.lit(1)) / F.col("n") / QUERIES_A_TASK
    sizes = materialize(sizes.withColumn("groups", F.greatest(F.ceil(share), F.lit(1)).cast("int")), "sizes")
    spark, fits = df.sparkSession, {}
    for d, n in sizes.filter("queries > 0 AND reach < n").select("d", "n").orderBy("d").collect():
        fits[d] = fit_curves(bounded_sample(vectors.filter(F.octet_length("vec") == width * d), n, SAMPLE, width), curves, seed)
    keyed = map_batches(vectors, partial(_keys, fits=fits, width=width), "d int, curve int, key long, id long, query boolean, offered boolean, sketch binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = keyed.repartitionByRange(parts, "d", "curve", "key", "id").sortWithinPartitions("d", "curve", "key", "id").withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "curves")
    part = F.shiftright("at", 33).alias("part")
    # A row for each partition and curve: where a curve's run in a partition starts.
    runs = ordered.groupBy("d", "curve", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("d", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("d", "curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    runs = runs.join(maybe_broadcast(sizes.filter("queries > 0")), "d")
    ranked = ordered.withColumn("part", part).join(maybe_broadcast(runs), ["d", "curve", "part"]).withColumn("rank", F.col("at") + F.col("base"))
    rows = ranked.filter("offered").select("d", "curve", F.floor(F.col("rank") / CHUNK).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("share"), "rank", F.lit(None).cast("long").alias("reach"), "id", "sketch")
    asked = ranked.filter("query").withColumn("share", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    low, high = F.greatest(F.col("rank") - F.col("reach"), F.lit(0)), F.least(F.col("rank") + F.col("reach"), F.col("n") - 1)
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.floor(low / CHUNK), F.floor(high / CHUNK)))).select("d", "curve", "chunk", "share", "rank", "reach", "id", "sketch")
    on = ["d", "curve", "chunk", "share"]
    met = rows.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    found = met.groupBy(*on).applyInArrow(lambda key, table: _nearest(table, k), "query_id long, vec_id long, low double, high double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    every = Window.partitionBy("query_id")
    bound = F.max(F.when(F.col("place") <= k, F.col("high"))).over(every)
    merged = merged.withColumn("place", F.row_number().over(every.orderBy("high", "vec_id"))).withColumn("bound", bound).filter("low <= bound")
    # The original vectors of what is left.
    asking = vectors.filter("query").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    offered = vectors.filter("offered").select(F.col("id").alias("vec_id"), F.col("vec").alias("v"))
    met = merged.select("query_id", "vec_id").join(asking, "query_id").join(offered, "vec_id").filter(F.octet_length("q") == F.octet_length("v"))
    scored = map_batches(met.select("query_id", "vec_id", "q", "v"), partial(_distances, width=width), "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(every.orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
