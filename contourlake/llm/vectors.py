"""Vectors as bytes: validity, bounded samples. A column of floats travels as 32 bits a component, any other as 64; all arithmetic is in double precision."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches


def width_of(df: DataFrame, column: str) -> int:
    """Bytes of a component."""
    return 4 if dict(df.dtypes)[column] == "array<float>" else 8


def _valid(batches, width: int):
    """(id, vec): the bytes of every vector that is neither null nor zero and holds finite numbers only; null ids go."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary())])
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(f"f{width}")  # a null component becomes nan
        run = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
        whole = (np.diff(run(~np.isfinite(values))) == 0) & (np.diff(run(values != 0)) > 0)
        there = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        vecs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), vecs], schema=schema).filter(pa.array(whole & there))


def valid_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """df(key, column array) -> id, vec."""
    width = width_of(df, column)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>" if width == 4 else "array<double>").alias("v"))
    return map_batches(rows, partial(_valid, width=width), "id long, vec binary")


def matrix(vecs, width: int) -> np.ndarray:
    """Rows in double precision from equally long byte strings."""
    vecs = list(vecs)
    return np.frombuffer(b"".join(vecs), f"f{width}").reshape(len(vecs), -1).astype(np.float64) if vecs else np.zeros((0, 0))


def bounded_sample(df: DataFrame, n: int, most: int, width: int, key: str = "id") -> np.ndarray:
    """Vectors of about ``most`` of ``n`` rows, never more, chosen by a hash of the id; the driver gets these only."""
    share = min(1.0, most / max(n, 1))
    picked = df.filter(F.shiftrightunsigned(F.xxhash64(F.lit(77), key), 11) <= F.lit(share * (1 << 53))).orderBy(key, "vec").limit(most)
    return matrix(picked.select("vec").toArrow().column("vec").to_pylist(), width)
