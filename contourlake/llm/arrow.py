"""Small helpers for functions that run on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of variable-length output after which a batch is handed on.
FLUSH_BYTES = 2 << 20
#: Bytes of text worked on at a time.
SLICE_BYTES = 4 << 20
#: Bytes after which Spark ends a batch on its way to a worker; without it a batch is 10,000 rows or 64 MB.
BATCH_BYTES = "8m"
#: Spark's own bound.
SPARK_BATCH_BYTES = "67108864b"


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _run(batches, fn):
    try:
        yield from fn(batches)
    finally:
        give_back()


def freed(fn, *args):
    """fn's result, after its memory has gone back."""
    try:
        return fn(*args)
    finally:
        give_back()


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` on batches bounded by bytes; a bound that the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == SPARK_BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(partial(_run, fn=fn), schema)


def slices(batches, column: int):
    """Batches cut so that the given string or binary column holds about SLICE_BYTES in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.column(column).nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def record_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
