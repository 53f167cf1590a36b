"""Replay of appended log rows for each project key.

A log folder is read as a file stream. Each micro-batch is appended to the state table of its query, keyed by batch, so that a batch that is run again overwrites
what its first try wrote; a refresh reads the whole history of a key in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def fan_out(stream: DataFrame, sessions: DataFrame, state: str, checkpoint: str, keys: list[str]):
    """Start a query that writes every new row once for each session of its key: (batch, user, row...). Ends when what is there has been read."""

    def push(batch: DataFrame, number: int) -> None:
        told = batch.join(sessions.select("user", *keys), keys)
        told.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(push).start()


def history(rows: DataFrame, keys: list[str], order: list[str], line) -> DataFrame:
    """keys, n, lines: everything said under a key, oldest first."""
    struct = F.struct(*order, line.alias("line"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(struct))["line"], "\n").alias("lines"))


def windowed_counts(stream: DataFrame, ts: str, late: str, size: str, by: str) -> DataFrame:
    """Events of a kind in tumbling windows, closed by a watermark: an extra for event tables."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"))
