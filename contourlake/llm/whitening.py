"""Embedding whitening by a compensated covariance.

Every component c becomes the whole number ``floor(scale * c) + shift``. Sums and centred outer products are accumulated in double-double: a pair
of doubles, high and low, whose sum carries some 106 bits. Products and sums are split without error (Dekker's product, Knuth's sum), so a
covariance loses nothing to a large mean. A task gives one row for each row of its matrix, high and low parts; rows are merged with the same arithmetic, first those
of ``MERGED`` tasks, then the rest, so no task holds more than it. The driver gets one matrix of the dimension of the vectors.

Eigenpairs come from the symmetric solver that reduces to tridiagonal form and divides and conquers (LAPACK ``syevd``, through numpy). Components are numbered from 1 by
falling eigenvalue; each has the sign that makes its largest entry positive. Components whose eigenvalue is not above rounding (1e-14 of the largest, or a variance of 0) are left
out, as nothing can be divided by it: fewer than asked for come back if the vectors span fewer.

Nulls: a null vector and one that holds null, NaN or infinite components takes no part; a null id is kept. Vectors of each length are fitted and whitened apart; empty vectors have no
component. Equal rows count and return as often as they occur. Components so large that the whole number passes 2^53 stay at 2^53, the range in which a double is exact. A deviation beyond 38
digits is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .common import discard, load, materialize

SPLIT = float((1 << 27) + 1)
EXACT = float(1 << 53)
#: Numbers of the products of a tile; tasks whose parts are merged in one group.
TILE, MERGED = 1 << 18, 256
#: Eigenvalues below this share of the largest are rounding.
ROUNDING = 1e-14


def two_sum(a, b):
    """a + b as (rounded sum, error)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b as (rounded product, error), for factors below 2^996."""
    p = a * b
    t = SPLIT * a
    ah = t - (t - a)
    t = SPLIT * b
    bh = t - (t - b)
    al, bl = a - ah, b - bh
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def add(x, y):
    """Sum of two pairs (high, low)."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray):
    """Sum of pairs along the first axis, halving it."""
    while len(high) > 1:
        odd = len(high) % 2
        half = add((high[: len(high) // 2], low[: len(high) // 2]), (high[len(high) // 2 : len(high) - odd], low[len(high) // 2 : len(high) - odd]))
        high, low = (np.concatenate([h, x[len(x) - odd :]]) for h, x in zip(half, (high, low), strict=True))
    return high[0], low[0]


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _part_schema():
    return pa.schema([("d", pa.int32()), ("i", pa.int32()), ("task", pa.int64()), ("n", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])


PART = "d int, i int, task long, n long, high binary, low binary"


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _by_length(batch: pa.RecordBatch):
    """(d, matrix) for the lengths of a batch of byte strings."""
    sizes = pc.binary_length(batch.column(0)).to_numpy()
    for size in np.unique(sizes[sizes > 0]).tolist():
        yield size // 8, _vectors(batch.column(0).filter(pa.array(sizes == size)), size // 8)


def _sums(batches):
    """Row -1 of each length: n and the sum of its vectors."""
    sums: dict = {}
    for batch in batches:
        for d, x in _by_length(batch):
            n, pair = sums.get(d, (0, (np.zeros(d), np.zeros(d))))
            sums[d] = n + len(x), add(pair, total(x, np.zeros_like(x)))
    rows = [(d, -1, _task(), n, h.tobytes(), l.tobytes()) for d, (n, (h, l)) in sums.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(_part_schema().names, r, strict=True)) for r in rows], schema=_part_schema())


def centred(x: np.ndarray, mean):
    """x minus the mean (high, low) as pairs."""
    high, low = two_sum(x, -mean[0])
    return two_sum(high, low - mean[1])


def outer_products(x: np.ndarray, mean, tile: int = TILE):
    """Sum of the centred rows' outer products, as pairs: the upper triangle, row by row."""
    d = x.shape[1]
    i, j = np.triu_indices(d)
    out, step = (np.zeros(len(i)), np.zeros(len(i))), max(1, tile // len(i))
    for at in range(0, len(x), step):
        high, low = centred(x[at : at + step], mean)
        p, e = two_product(high[:, i], high[:, j])
        out = add(out, total(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j])))
    return out


def _products(batches, means: dict):
    parts: dict = {}
    for batch in batches:
        for d, x in _by_length(batch):
            n, pair = parts.get(d, (0, None))
            more = outer_products(x, means[d])
            parts[d] = n + len(x), add(pair, more) if pair else more
    for d, (n, (high, low)) in parts.items():
        ends = np.cumsum(np.arange(d, 0, -1))
        rows = [(d, i, _task(), n, high[end - d + i : end].tobytes(), low[end - d + i : end].tobytes()) for i, end in enumerate(ends.tolist())]
        yield pa.RecordBatch.from_pylist([dict(zip(_part_schema().names, r, strict=True)) for r in rows], schema=_part_schema())


def _merge(table: pa.Table) -> pa.Table:
    """Parts of one row of one matrix, in the order of their tasks, as one part."""
    table = table.sort_by([("task", "ascending")])
    columns = [np.stack([np.frombuffer(x, np.float64) for x in table.column(c).to_pylist()]) for c in ("high", "low")]
    high, low = total(*columns)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_pylist([first | {"n": sum(table.column("n").to_pylist()), "high": high.tobytes(), "low": low.tobytes()}], schema=_part_schema())


def _merged(parts: DataFrame) -> dict:
    """d -> (n, high, low): what all tasks give together; rows of a matrix one after the other."""
    some = parts.withColumn("some", F.floor(F.col("task") / MERGED)).groupBy("d", "i", "some").applyInArrow(lambda key, t: _merge(t), PART)
    rows = some.groupBy("d", "i").applyInArrow(lambda key, t: _merge(t), PART).orderBy("d", "i").collect()  # d rows for each length d
    out: dict = {}
    for r in rows:
        out.setdefault(r["d"], []).append(r)
    return {d: (own[0]["n"], *(np.concatenate([np.frombuffer(r[c], np.float64) for r in own]) for c in ("high", "low"))) for d, own in out.items()}


def _symmetric(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


@dataclass
class Moments:
    """n, exact sums (high and low part), mean as a pair and covariance (divisor n) of the vectors of one length."""

    n: int
    sums: list
    mean: tuple
    covariance: np.ndarray


def moments(vectors: DataFrame) -> dict[int, Moments]:
    """vectors(vec binary: doubles) -> by length; two passes."""
    vectors = vectors.select("vec")
    sums, means = {}, {}
    for d, (n, high, low) in _merged(map_batches(vectors, _sums, PART)).items():
        sums[d] = n, high, low
        # Quotient of a pair by a whole number: the remainder of the first quotient is exact.
        q = high / n
        p, e = two_product(q, np.full(d, float(n)))
        means[d] = two_sum(q, (((high - p) - e) + low) / n)
    if not sums:
        return {}
    found = _merged(map_batches(vectors, partial(_products, means=means), PART))
    return {d: Moments(n, [(float(h), float(l)) for h, l in zip(*sums[d][1:], strict=True)], means[d], _symmetric((high + low) / n, d)) for d, (n, high, low) in found.items()}


@dataclass
class Whitening:
    """Of one length: n, whole sums, eigenvectors as columns, eigenvalues, shares of the trace."""

    n: int
    sums: list
    mean: tuple
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.mean)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S)^2."""
        far = max((abs(float(s)) for s in self.sums), default=0.0) + self.n * float(np.abs(x).max(initial=0))
        if far < 2.0**62:
            k = x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
            if float(np.abs(k).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
                return (k * k).sum(axis=1).tolist()
            return [sum(v * v for v in row) for row in k.tolist()]
        return [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.astype(np.int64).tolist()]


def fit_whitening(found: Moments, components: int) -> Whitening:
    values, vectors = np.linalg.eigh(found.covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sound = values > max(ROUNDING * values[0], 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[sound], vectors[:, sound]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.size else vectors
    trace = float(np.trace(found.covariance)) or 1.0
    return Whitening(found.n, [int(h) + int(l) for h, l in found.sums], found.mean, np.ascontiguousarray(vectors), values, values / trace)


def _whole(batches, scale: float, shift: int):
    """(id, vec) of the rows that take part: doubles that are whole numbers."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary())])
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[ends]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.clip(np.floor(values * scale) + shift, -EXACT, EXACT)
        vecs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
        keep = (np.diff(bad) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), vecs], schema=schema).filter(pa.array(keep))


OUT = "id long, n long, deviation decimal(38,0), vec binary, whitened array<double>"


def _whiten(batches, fits: dict):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("vec", pa.binary()), ("whitened", pa.list_(pa.float64()))])
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy()
        for size in np.unique(sizes[sizes > 0]).tolist():
            fit, own = fits[size // 8], batch.filter(pa.array(sizes == size))
            x = _vectors(own.column(1), size // 8)
            if not len(fit.values):
                continue
            far = [Decimal(v) if v < 10**38 else None for v in fit.deviations(x)]
            white = fit.apply(x)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([fit.n] * len(x), pa.int64()), pa.array(far, schema.field(2).type), pa.array([w.tobytes() for w in white], pa.binary()), pa.array(white.tolist(), schema.field(4).type)], schema=schema)


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000):
    """df(key, column array) -> (rows, fits, errors).

    rows: key, n, deviation decimal(38,0), whitened array<double>, d (length of the vector). fits: a :class:`Whitening` for each length. errors: for each
    length the largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows.
    """
    raw = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    vectors = materialize(map_batches(raw, partial(_whole, scale=scale, shift=shift), "id long, vec binary"), "whiten-vectors")
    fits = {d: fit_whitening(m, components) for d, m in moments(vectors).items()}
    sizes = vectors.withColumn("d", (F.octet_length("vec") / 8).cast("int"))
    parts, errors = [], {}
    for d, fit in sorted(fits.items()):
        # A table for each length: numbers of components differ.
        rows = map_batches(sizes.filter(F.col("d") == d).select("id", "vec"), partial(_whiten, fits={d: fit}), OUT)
        rows = materialize(rows, "whitened")
        own = moments(rows) if len(fit.values) else {}
        errors[d] = max((float(np.abs(m.covariance - np.eye(k)).max()) for k, m in own.items()), default=0.0)
        parts.append(rows.withColumn("d", F.lit(d)))
    discard(vectors)
    none = df.sparkSession.createDataFrame([], f"{OUT}, d int")
    rows = parts[0] if len(parts) == 1 else none if not parts else none.unionByName(parts[0])
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.drop("vec").withColumnRenamed("id", key), fits, errors


def whitened_rows(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation (long; null if it does not fit), whitened, explained, identity_error."""
    rows, fits, errors = whiten(df, key, column, components)
    told = [(d, i, float(share), errors[d]) for d, fit in fits.items() for i, share in enumerate(fit.explained)]
    # A row for each length and component.
    known = df.sparkSession.createDataFrame(told, "d int, at int, explained double, identity_error double")
    out = rows.select(key, "n", "deviation", "d", F.posexplode("whitened").alias("at", "whitened")).join(F.broadcast(known), ["d", "at"])
    return out.select(key, (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_rows(load(spark, sf_dir, "embeddings"))
