"""Where tables between jobs go, and checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests, one machine), a folder made for it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="contourlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths written inside the innermost :func:`temporary` of this thread or task of control.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table of the shared folder: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/contourlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that :func:`cut` writes inside are deleted at the end; what outlives them is written by the function it gives. Threads do not see each other's."""
    outer, own = _written.get(), []
    token = _written.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _written.set(outer)
        try:
            return cut(df, name)
        finally:
            _written.reset(inner)

    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row; a nested value counts by its text."""
    kinds = {"string": F.octet_length, "binary": F.octet_length}
    fixed = lambda c: F.lit(8)
    nested = lambda c: F.octet_length(F.to_json(F.struct(c)))
    parts = [F.coalesce(kinds.get(t, nested if t.startswith(("array", "struct", "map")) else fixed)(F.col(c)), F.lit(0)) for c, t in df.dtypes]
    return reduce(lambda a, b: a + b, parts, F.lit(16)).cast("long")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the table's rows, measured, are small, else the table as it is."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0) <= most else df


def numbered(df: DataFrame, order: list, name: str, first: int = 0, kind: str = "int") -> DataFrame:
    """``df`` with each row's place, an int or a long (``kind``), by ``order`` (a total order): range partitions, counts of each, then places inside, so no task sees all rows."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = cut(at, name).withColumn("_part", F.shiftright("_at", 33))
    # A row for each partition.
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low") + first).alias("_base"))
    return at.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_at") + F.col("_base")).cast(kind).alias(name))
