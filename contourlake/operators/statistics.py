"""Aggregates of functions and vectors, whole or for each component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small


def mean_vector(points: DataFrame, vector: str = "v", by: list[str] | None = None) -> DataFrame:
    """by..., mean: the mean of each component; sums combine before the shuffle, by (group, place)."""
    by = by or []
    means = points.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return whole.select(*by, F.col("c.m").alias("mean"))


def spread(points: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """by, area: the sum of distances to the group's centroid over (members - 1); 0.1 where that is not positive."""
    centres = small(mean_vector(points, vector, [by]))
    d2 = F.aggregate(F.zip_with(vector, "mean", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    sums = points.join(centres, by).groupBy(by).agg(F.sum(F.sqrt(d2)).alias("s"), F.count(F.lit(1)).alias("n"))
    area = F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return sums.select(by, F.when(area > 0, area).otherwise(F.lit(0.1)).alias("area"))


def function_range(values: DataFrame, f: str = "f") -> DataFrame:
    """min, max, range, a range of 0 counting as 1."""
    return values.agg(F.min(f).alias("min_f"), F.max(f).alias("max_f")).withColumn("range_f", F.when(F.col("max_f") == F.col("min_f"), F.lit(1.0)).otherwise(F.col("max_f") - F.col("min_f")))


def component_statistics(rows: DataFrame, by: str) -> DataFrame:
    """rows(by, f, g) -> by, n, mean_g, stdev_g (population), corr_fg (1 where either does not vary)."""
    flat = (F.min("f") == F.max("f")) | (F.min("g") == F.max("g"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean_g"), F.stddev_pop("g").alias("stdev_g"), F.when(flat, F.lit(1.0)).otherwise(F.try_divide(F.covar_pop("f", "g"), F.stddev_pop("f") * F.stddev_pop("g"))).alias("corr_fg")
    )


def region_counts(rows: DataFrame, by: str, inside) -> DataFrame:
    """by, n_inside, min_count, max_count: members in a region for each group, and the range over all groups."""
    counts = rows.groupBy(by).agg(F.count_if(inside).alias("n_inside"))
    everything = Window.partitionBy(F.lit(0))  # one row for each group
    return counts.select(by, "n_inside", F.min("n_inside").over(everything).alias("min_count"), F.max("n_inside").over(everything).alias("max_count"))


def composition(rows: DataFrame, by: str, conditions: list, totals: list[int] | None = None) -> DataFrame:
    """by, share_1 ...: members in each of several ranges, each over the range's own total, then over their sum (0 where that is 0)."""
    counts = rows.groupBy(by).agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions)))
    if totals is None:
        row = rows.agg(*(F.count_if(c) for c in conditions)).first()
        totals = [row[i] for i in range(len(conditions))]
    parts = [F.col(f"c{i}") / F.lit(float(max(t, 1))) for i, t in enumerate(totals)]
    whole = sum(parts[1:], parts[0])
    return counts.select(by, *(F.when(whole == 0, F.lit(0.0)).otherwise(p / whole).alias(f"share_{i + 1}") for i, p in enumerate(parts)))


def is_binary(values: DataFrame, g: str) -> DataFrame:
    return values.agg((F.count_distinct(g) == 2).alias("is_binary"))


def histogram(values: DataFrame, bins: int, f: str = "f", closed: bool = True) -> DataFrame:
    """bin, share. ``closed``: bins over the range, the maximum in the last; else the range spans bins - 1 (for densities)."""
    ranged = values.crossJoin(F.broadcast(function_range(values, f)))  # one row
    place = F.floor(F.lit(float(bins if closed else bins - 1)) * (F.col(f) - F.col("min_f")) / F.col("range_f"))
    counts = ranged.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row for each bin
    return every.join(counts, "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) / total).alias("share"))


def density(shares: DataFrame, radius: int = 10) -> DataFrame:
    """bin, density: Epanechnikov kernel over the bins within the radius, over the largest; shares(bin, share)."""
    near = shares.select(F.explode(F.sequence(F.col("bin") - radius, F.col("bin") + radius)).alias("at"), "bin", "share")
    u = (F.col("at") - F.col("bin")) / F.lit(float(radius))
    sums = near.groupBy("at").agg(F.sum(0.75 * (1 - u * u) * F.col("share")).alias("d"))
    own = shares.select("bin").join(sums, F.col("bin") == F.col("at"))
    top = F.max("d").over(Window.partitionBy(F.lit(0)))
    return own.select("bin", F.when(top == 0, F.lit(0.0)).otherwise(F.col("d") / top).alias("density"))


def normalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] over all rows."""
    limits = rows.agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))
    out = rows.crossJoin(F.broadcast(limits))  # one row
    for c in columns:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        out = out.withColumn(c, (F.col(c) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))
    return out.select(*rows.columns)


def nearest_to(rows: DataFrame, key: str, x: float, y: float) -> DataFrame:
    """The row nearest to a position; ties to the smaller key. Aggregated, so each task sends one row."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return rows.agg(F.min(F.struct(d2.alias("d2"), key)).alias("m")).select(f"m.{key}", "m.d2")


def coincident_pairs(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """a, b: consecutive rows at one position."""
    after = F.lead(key).over(Window.partitionBy(*position).orderBy(key))
    return rows.select(F.col(key).alias("a"), after.alias("b")).filter("b IS NOT NULL")


def _square(p: str, q: str):
    """Squared distance of the positions of two sides, folded in the order x, y, z."""
    gap = lambda c: (F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) * (F.col(f"{p}.{c}") - F.col(f"{q}.{c}"))
    return gap("x") + gap("y") + gap("z")


def nearest_between(a: DataFrame, b: DataFrame, by: str, probes: int = 32) -> DataFrame:
    """by, a, b, d2: of two sets of positions (by, id, x, y, z), the nearest pair of each group; ties to the smaller ids.

    A bound comes first: the distance from some positions of ``a`` (``probes`` of each group, by hash) to all of ``b``. Cells of that size then hold the nearest pair in one cell or in two that touch, so only those join. A bound of 0
    leaves equal positions only.
    """
    a, b = (cut(side.select(by, "id", *(F.col(c).cast("double").alias(c) for c in "xyz")), "positions") for side in (a, b))
    few = a.groupBy(by, F.pmod(F.xxhash64("id"), F.lit(probes)).alias("_s")).agg(F.min_by(F.struct("x", "y", "z"), "id").alias("p")).select(by, "p.*")
    bounds = few.alias("p").join(b.alias("q"), F.col(f"p.{by}") == F.col(f"q.{by}")).groupBy(F.col(f"p.{by}").alias("_k")).agg(F.sqrt(F.min(_square("p", "q"))).alias("_size"))
    bounds = small(cut(bounds, "bounds"))
    # A little more than the bound, as cells are found by division.
    size = F.col("_size") * (1 + 1e-9)
    cell = lambda c: F.when(F.col("_size") > 0, F.floor(F.col(c) / size).cast("double")).otherwise(F.col(c))
    placed = lambda side: side.join(bounds, F.col(by) == F.col("_k")).drop("_k").withColumns({f"c{c}": cell(c) for c in "xyz"})
    around = placed(b)
    for c in "xyz":
        steps = F.when(F.col("_size") > 0, F.array(*(F.lit(float(i)) for i in (-1, 0, 1)))).otherwise(F.array(F.lit(0.0)))
        around = around.withColumn("_step", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_step")).drop("_step")
    keys = [by, "cx", "cy", "cz"]
    x, y = placed(a).alias("p"), around.alias("q")
    pairs = x.join(y, reduce(lambda m, n: m & n, (F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys)))
    best = F.min(F.struct(_square("p", "q").alias("d2"), F.col("p.id").alias("a"), F.col("q.id").alias("b")))
    return pairs.groupBy(F.col(f"p.{by}").alias(by)).agg(best.alias("m")).select(by, "m.a", "m.b", "m.d2")


def backbone_steps(backbone: DataFrame) -> DataFrame:
    """conf_id, res_idx, d, mean_d, drawn: distance to the next atom, the structure's mean of it, and whether the bond is shorter than three times that."""
    order = Window.partitionBy("conf_id").orderBy("res_idx")
    gap = lambda c: F.lead(F.col(c).cast("double")).over(order) - F.col(c).cast("double")
    step = F.sqrt(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z"))
    steps = backbone.withColumn("d", step).filter("d IS NOT NULL").withColumn("mean_d", F.avg("d").over(Window.partitionBy("conf_id")))
    return steps.select("conf_id", "res_idx", "d", "mean_d", (F.col("d") < 3 * F.col("mean_d")).alias("drawn"))


def contact_density(backbone: DataFrame, residues: list[int] | None = None, squared: float = 49.0) -> DataFrame:
    """conf_id, contacts: pairs of atoms (of the residues, or all) of a squared distance of at most ``squared``. Each structure's atoms are one array, so pairs never leave a row."""
    own = backbone if residues is None else backbone.filter(F.col("res_idx").isin(residues))
    whole = own.groupBy("conf_id").agg(F.array_sort(F.collect_list(F.struct("res_idx", *(F.col(c).cast("double").alias(c) for c in "xyz")))).alias("a"))
    square = lambda p, q, c: (p[c] - q[c]) * (p[c] - q[c])
    near = lambda p, q: square(p, q, "x") + square(p, q, "y") + square(p, q, "z") <= squared
    counts = F.transform("a", lambda p: F.size(F.filter("a", lambda q: (q["res_idx"] > p["res_idx"]) & near(p, q))))
    return whole.select("conf_id", F.aggregate(counts, F.lit(0), lambda s, x: s + x).alias("contacts"))


def grouped_names(names: DataFrame, size: int = 30) -> DataFrame:
    """parent, chunk, members: paths by folder, in chunks of a menu's size."""
    cut_at = F.col("path").substr(F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)))
    own = names.withColumn("parent", cut_at)
    chunk = F.floor((F.row_number().over(Window.partitionBy("parent").orderBy("path")) - 1) / size).cast("int")
    return own.withColumn("chunk", chunk).groupBy("parent", "chunk").agg(F.count(F.lit(1)).alias("members"))


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str, step: str) -> DataFrame:
    """rows(key, step) whose step lies in a range of their key: ranges(key, lo, hi), ends included. An equi-join on the key, each row once."""
    own = ranges.groupBy(key).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    inside = F.exists("_ranges", lambda r: (F.col(step) >= r["lo"]) & (F.col(step) <= r["hi"]))
    return rows.join(small(own), key).filter(inside).drop("_ranges")


def strata(rows: DataFrame, z: str, low: float, high: float) -> DataFrame:
    """Rows of a half-open stratum."""
    return rows.filter((F.col(z) >= low) & (F.col(z) < high))


def nearest_to_path(vertices: DataFrame, path: DataFrame) -> DataFrame:
    """id, on, d2: of vertices(id, x, y, z) the nearest to any of path(id, x, y, z), ties to the smaller ids. The path is one value; each task sends one row."""
    steps = path.agg(F.collect_list(F.struct("id", "x", "y", "z")).alias("_path"))
    square = lambda p, c: (F.col(c) - p[c]) * (F.col(c) - p[c])
    gaps = F.transform("_path", lambda p: F.struct((square(p, "x") + square(p, "y") + square(p, "z")).alias("d2"), p["id"].alias("on")))
    best = vertices.crossJoin(F.broadcast(steps)).select(F.struct(F.array_min(gaps).alias("g"), "id").alias("m"))  # one row
    return best.agg(F.min(F.struct(F.col("m.g.d2"), F.col("m.id"), F.col("m.g.on"))).alias("m")).select("m.id", "m.on", "m.d2")


def distinct_in_region(rows: DataFrame, v: str, inside) -> DataFrame:
    """n: the distinct vertices of all edges that lie in a region."""
    return rows.filter(inside).select(v).distinct().agg(F.count(F.lit(1)).alias("n"))


def progress(tasks: DataFrame, by: str, done, order: list[str], message: str, last: int = 5) -> DataFrame:
    """by, total, completed, share, messages: how far each group of tasks is, and its last messages, oldest first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order)))
    ranked = tasks.withColumn("_place", place)
    latest = F.collect_list(F.when(F.col("_place") <= last, F.struct((-F.col("_place")).alias("p"), F.col(message).alias("m"))))
    counts = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.array_sort(latest)["m"].alias("messages"))
    return counts.select(by, "total", "completed", (F.col("completed") / F.col("total")).alias("share"), "messages")
