"""Shared helpers: table loading, lineage cuts in the shared folder, hierarchical running sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where the session names none and runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="contourlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/contourlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, by: str, parts: int) -> DataFrame:
    """The same with rows dealt to files by a hash of ``by``: what groups by it reads them without another shuffle."""
    spark = df.sparkSession
    table, path = f"contourlake_{uuid.uuid4().hex}", f"{shared_dir(spark)}/contourlake/{name}-{uuid.uuid4().hex}"
    df.write.bucketBy(parts, by).option("path", path).format("parquet").saveAsTable(table)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.table(table)
    # The plan knows the files; the catalog needs no entry, and the files of a table with a path stay.
    spark.sql(f"DROP TABLE {table}")
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


#: Paths written inside each open :func:`scratch`.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go when it ends; what outlives them is the function it gives, which writes a table that stays.

    For a result that is written inside, as everything that its plan reads goes too.
    """
    _scopes.append([])
    try:
        yield lambda df, name: _outside(df, name)
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _outside(df: DataFrame, name: str) -> DataFrame:
    inner = _scopes.pop()
    try:
        return materialize(df, name)
    finally:
        _scopes.append(inner)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row; a nested value counts by its text."""
    kinds = {"string": F.octet_length, "binary": F.octet_length}
    fixed = lambda c: F.lit(8)
    nested = lambda c: F.octet_length(F.to_json(F.struct(c)))
    parts = [F.coalesce(kinds.get(t, nested if t.startswith(("array", "struct", "map")) else fixed)(F.col(c)), F.lit(0)) for c, t in df.dtypes]
    return reduce(lambda a, b: a + b, parts, F.lit(16)).cast("long")


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its rows, measured, are small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0) <= max_bytes else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of maximal runs outside space and \\t-\\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Buckets whose totals one window adds up.
SUPER = 4096


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``keys`` that precede by (``bucket``, ``order``).

    A window inside each (keys, bucket), one over the totals of SUPER buckets, and one over their totals, so that a key with most of the
    rows is spread and no window holds more than SUPER rows for each level below it.
    """
    df = df.withColumn("_v", value)

    def before(c: str, parts: list[str], by: list[Column]) -> Column:
        return F.coalesce(F.sum(c).over(Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inner = df.withColumn("_in", before("_v", [*keys, bucket], order))
    totals = df.groupBy(*keys, bucket).agg(F.sum("_v").alias("_t")).withColumn("_s", F.floor(F.col(bucket) / SUPER))
    tops = totals.groupBy(*keys, "_s").agg(F.sum("_t").alias("_t")).select(*keys, "_s", before("_t", keys, [F.col("_s")]).alias("_top"))
    base = totals.withColumn("_mid", before("_t", [*keys, "_s"], [F.col(bucket)])).join(tops, [*keys, "_s"]).select(*keys, bucket, (F.col("_mid") + F.col("_top")).alias("_base"))
    return inner.join(base, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_base")).drop("_v", "_in", "_base")


def global_before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over all rows that precede by ``order`` (a total order): range partitions, and a window over their totals."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), name)
    # A row for each partition.
    totals = placed.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{out}") for out, c in sums.items()))
    first = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_p", *(F.coalesce(F.sum(f"_t_{out}").over(first), F.lit(0)).alias(f"_b_{out}") for out in sums))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for out, c in sums.items():
        placed = placed.withColumn(out, F.coalesce(F.sum(c).over(within), F.lit(0)))
    joined = placed.join(F.broadcast(totals), "_p")
    return joined.select(*df.columns, *((F.col(out) + F.col(f"_b_{out}")).alias(out) for out in sums))
