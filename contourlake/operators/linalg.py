"""Point clouds by principal components, and rigid alignment of structures."""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import linalg
from .common import cut, discard, small, temporary


def component_basis(points: DataFrame, components: int = 500, sample: int = 3000, key: str = "conf_id", vector: str = "v") -> dict:
    """mean, components, variances of a bounded sample (rows of the smallest hashes of the key)."""
    picked = points.orderBy(F.xxhash64(F.lit(11), key), key).limit(sample).select(vector).toPandas()[vector]
    x = np.array(picked.tolist(), np.float64)
    mean, rows, variances = linalg.principal_components(x, min(components, max(len(x) - 1, 1)))
    return {"mean": mean, "components": rows, "variances": variances}


def total_variance(points: DataFrame, vector: str = "v") -> DataFrame:
    """total: the sum of the sample variances of all coordinates, over all rows; null for fewer than two."""
    coordinates = points.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    return coordinates.groupBy("pos").agg(F.var_samp("x").alias("s")).agg(F.sum("s").alias("total"))


def project(points: DataFrame, basis: dict, key: str = "conf_id", vector: str = "v") -> DataFrame:
    """key, v: float32 coordinates along the components."""
    mean, rows = basis["mean"], basis["components"]

    def run(batches):
        for batch in batches:
            x = np.array(batch[vector].tolist(), np.float64).reshape(len(batch), -1)
            yield pd.DataFrame({key: batch[key], "v": list(((x - mean) @ rows.T).astype(np.float32))})

    return points.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInPandas(run, f"{key} long, v array<float>")


def point_cloud(distance_vectors: DataFrame, components: int = 500, sample: int = 3000) -> DataFrame:
    return project(distance_vectors, component_basis(distance_vectors, components, sample))


def _rotated(batches, target: dict, by: str):
    """Centred shapes turned onto their group's target."""
    for batch in batches:
        keys, out = batch.column(0).to_pylist(), []
        for key, shape in zip(keys, batch.column(2).to_pylist(), strict=True):
            x = np.array(shape, np.float64).reshape(-1, 3)
            out.append(linalg.align(x, target[key]).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=[by, "conf_id", "x"])


def alignment(shapes: DataFrame, by: str, rounds: int = 2) -> DataFrame:
    """shapes(by, conf_id, xyz array<array<double>>) -> by, conf_id, rmsd, used: to the consensus of the group; shapes of another length than the first (by id) are told, not used.

    Generalised: every round turns each shape onto its group's consensus (the first shape at the start) and averages the turned ones. Shapes of a group are spread over tasks; what is together is the consensus of each group, one shape
    for each, and the sums of a round by (group, coordinate). The driver holds one shape for each group, so groups must be bounded (labels), not their members.
    """
    with temporary(shapes.sparkSession) as keep:
        return keep(_aligned(shapes, by, rounds), "aligned")


def _aligned(shapes: DataFrame, by: str, rounds: int) -> DataFrame:
    kind = dict(shapes.dtypes)[by]
    points = F.col("xyz")
    first = shapes.groupBy(F.col(by).alias("_k")).agg(F.min_by(F.size(points), "conf_id").alias("_m"))
    known = shapes.join(small(first), F.col(by).eqNullSafe(F.col("_k"))).select(by, F.col("conf_id").cast("long").alias("conf_id"), "xyz", ((F.size(points) == F.col("_m")) & (F.col("_m") > 0)).alias("used"))
    known = cut(known, "shapes")
    mean = lambda i: F.aggregate("xyz", F.lit(0.0), lambda s, p: s + p[i]) / F.size("xyz")
    own = known.filter("used").withColumns({f"m{i}": mean(i) for i in range(3)})
    centred = cut(own.select(by, "conf_id", F.flatten(F.transform("xyz", lambda p: F.array(*(p[i] - F.col(f"m{i}") for i in range(3))))).alias("x")), "centred")
    start = centred.groupBy(by).agg(F.min_by("x", "conf_id").alias("x")).collect()
    target = {r[by]: np.array(r["x"]).reshape(-1, 3) for r in start}
    for _ in range(rounds):
        turned = centred.mapInArrow(partial(_rotated, target=target, by=by), f"{by} {kind}, conf_id long, x array<double>")
        centred = cut(turned, "turned")
        sums = centred.select(by, F.posexplode("x").alias("at", "c")).groupBy(by, "at").agg(F.avg("c").alias("c"))
        means = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda m: m["c"]).alias("x")).collect()
        target = {r[by]: np.array(r["x"]).reshape(-1, 3) for r in means}
        target = {key: x - x.mean(axis=0) for key, x in target.items()}
    told = known.sparkSession.createDataFrame([(key, x.ravel().tolist()) for key, x in target.items()], f"_k {kind}, _t array<double>")
    off = F.aggregate(F.zip_with("x", "_t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    rmsd = centred.join(small(told), F.col(by).eqNullSafe(F.col("_k"))).select(by, "conf_id", F.sqrt(off / (F.size("x") / 3)).alias("rmsd"))
    rmsd = rmsd.withColumn("used", F.lit(True))
    return rmsd.select(by, "conf_id", "rmsd", "used").unionByName(known.filter("NOT used").select(by, "conf_id", F.lit(None).cast("double").alias("rmsd"), "used"))


#: Vertices and links of a graph whose vectors one task may hold.
TASK_LINKS = 20_000_000


def largest_eigenpairs(weighted: DataFrame, k: int, basis: int | None = None, tolerance: float = 1e-10, restarts: int = 60) -> tuple[list[float], DataFrame]:
    """weighted(src, dst, w), both directions of a symmetric matrix M -> (the k largest eigenvalues, falling; (v, j, x) their unit vectors).

    Lanczos with thick restarts and whole reorthogonalisation. A vector is a table (v, x), the basis a table (v, j, x) partitioned by v; a product with M is a join and a sum by row. Only inner products and the small projected
    matrix (``basis`` wide) are on the driver. The start vector comes from a hash of v, so reruns agree. Stops when the residuals of the k pairs are within the tolerance times the largest value.
    """
    spark = weighted.sparkSession
    m = cut(weighted.groupBy("src", "dst").agg(F.sum("w").alias("w")), "matrix")
    names = cut(m.select(F.col("src").alias("v")).distinct(), "vertices")
    n = names.count()
    k = min(k, n)
    size = min(n, basis or max(2 * k + 8, 20))
    if not n:
        return [], spark.createDataFrame([], "v long, j int, x double")
    start = names.select("v", (F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(1 << 20)) / (1 << 19) - 1 + 1e-3).alias("x"))
    dot = lambda t: float(t.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0)
    norm = math.sqrt(dot(start))
    # The basis: tables that are each written once.
    pieces = [cut(start.select("v", F.lit(0).alias("j"), (F.col("x") / norm).alias("x")), "basis")]
    projected, count = np.zeros((size, size)), 1
    for _ in range(restarts):
        while True:
            # The last basis vector times M, less what of it lies in the basis, twice.
            held = reduce(DataFrame.unionByName, pieces)
            last = held.filter(F.col("j") == count - 1).select(F.col("v").alias("dst"), "x")
            residual = cut(names.join(m.join(last, "dst").groupBy(F.col("src").alias("v")).agg(F.sum(F.col("w") * F.col("x")).alias("x")), "v", "left").fillna(0.0, ["x"]), "product")
            for again in range(2):
                parts = held.join(residual.withColumnRenamed("x", "y"), "v").groupBy("j").agg(F.sum(F.col("x") * F.col("y")).alias("c")).collect()
                if not again:
                    for r in parts:
                        projected[r["j"], count - 1] = projected[count - 1, r["j"]] = r["c"]
                told = F.broadcast(spark.createDataFrame([(r["j"], r["c"]) for r in parts], "j int, c double"))
                inside = held.join(told, "j").groupBy("v").agg(F.sum(F.col("x") * F.col("c")).alias("y"))
                less = cut(residual.join(inside, "v", "left").select("v", (F.col("x") - F.coalesce("y", F.lit(0.0))).alias("x")), "residual")
                discard(residual)
                residual = less
            beta = math.sqrt(dot(residual))
            if count == size or beta <= tolerance * max(1.0, np.abs(projected[:count, :count]).max()):
                break
            pieces.append(residual.select("v", F.lit(count).alias("j"), (F.col("x") / beta).alias("x")))
            count += 1
        values, vectors = np.linalg.eigh(projected[:count, :count])
        values, vectors = values[::-1], vectors[:, ::-1]
        done = count < size or count == n or (beta * np.abs(vectors[-1, :k]) <= tolerance * max(abs(values[0]), 1e-300)).all()
        keep = min(k if done else min(k + 4, count - 2), count)
        told = spark.createDataFrame([(j, i, float(vectors[j, i])) for j in range(count) for i in range(keep)], "j int, i int, _w double")
        ritz = held.join(F.broadcast(told), "j").groupBy("v", F.col("i").alias("j")).agg(F.sum(F.col("x") * F.col("_w")).alias("x"))
        if done:
            return values[:k].tolist(), cut(ritz, "eigenvectors")
        # The basis begins again with the best vectors and the residual.
        pieces = [cut(ritz.unionByName(residual.select("v", F.lit(keep).alias("j"), (F.col("x") / beta).alias("x"))), "basis")]
        projected = np.zeros((size, size))
        projected[range(keep), range(keep)] = values[:keep]
        count = keep + 1
    raise RuntimeError(f"eigenpairs did not settle in {restarts} restarts")


def _sparse(table: pa.Table, k: int) -> pa.Table:
    src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    values = linalg.lanczos(at[: len(src)], at[len(src) :], w, len(names), k)
    return pa.table({"rank": pa.array(range(1, len(values) + 1), pa.int32()), "value": pa.array(values, pa.float64())})


def graph_eigenvalues(edges: DataFrame, k: int) -> DataFrame:
    """edges(src, dst) -> rank, value: the k largest eigenvalues of A x = l D x, D the degrees; those of the symmetric D^-1/2 A D^-1/2.

    By Lanczos: in one task for a graph of up to ``TASK_LINKS`` links, beyond that by :func:`largest_eigenpairs`. No square array is made. Loops and repeats are left out. A value that occurs several times is found as often as the start vector's rounding lets it, once at least.
    """
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = cut(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ends.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "both")
    degree = cut(both.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n")), "degrees")
    weighted = both.join(degree.toDF("src", "n1"), "src").join(degree.toDF("dst", "n2"), "dst").select("src", "dst", (1 / F.sqrt(F.col("n1") * F.col("n2"))).alias("w"))
    if both.count() <= TASK_LINKS:
        one = weighted.groupBy(F.lit(0).alias("one")).applyInArrow(lambda key, t: _sparse(t, k), "rank int, value double")
        return one
    values, _ = largest_eigenpairs(weighted, k)
    return edges.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "rank int, value double")
