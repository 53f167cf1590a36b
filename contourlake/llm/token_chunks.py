"""A corpus as chunks of word ids: the table that corpus-wide n-gram operators work on.

A row holds some whole documents: their ids, a flag for each, their word counts, all words as numbers local to the chunk (frequent words
small, byte planes apart, compressed), and a 64-bit hash of each distinct word. Words are the runs outside space and \\t-\\r of the text
with A-Z lower-cased. Chunks end after ``CHUNK_WORDS`` words, so rows have bounded size however large the input or a partition is.

Questions about a chunk's distinct items travel as packed columns, one row for each chunk and shard, and the answers come back in the order of the
questions. So what is shuffled is each item once for each chunk, not once for each document, and a frequent item weighs no more than a rare one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, slices
from .common import materialize, materialize_buckets

CHUNK_WORDS = 1_000_000
COLUMNS = "chunk long, words long, docs binary, nulls binary, flags binary, lengths binary, tokens binary, vocab binary"


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes of the numbers, first bytes first."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1) if data else np.zeros(0, dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _chunks(batches, words_a_chunk: int):
    import xxhash
    from pyspark import TaskContext

    schema = pa.schema([("chunk", pa.int64()), ("words", pa.int64())] + [(c, pa.binary()) for c in ("docs", "nulls", "flags", "lengths", "tokens", "vocab")])
    part, made = TaskContext.get().partitionId(), 0
    docs, nulls, flags, lengths, tokens, numbers, held = [], [], [], [], [], Numbers(), 0

    def row():
        ids = np.concatenate([np.zeros(0, np.uint32), *tokens])
        order = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        vocab = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))[order]
        packed = [planes(np.array(docs, np.int64)), np.array(nulls, np.uint8).tobytes(), np.array(flags, np.uint8).tobytes(), planes(np.array(lengths, np.uint32)), zstandard.compress(planes(place[ids]), 1), vocab.tobytes()]
        return record_batch([[(part << 32) + made], [len(ids)], *[[p] for p in packed]], schema)

    for batch in slices(batches, 2):
        for doc, flag, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.lower().split() if text else []
            docs.append(doc or 0), nulls.append(doc is None), flags.append(flag), lengths.append(len(words))
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            held += len(words) + 1
            if held >= words_a_chunk:
                yield row()
                docs, nulls, flags, lengths, tokens, numbers, held, made = [], [], [], [], [], Numbers(), 0, made + 1
    if docs:
        yield row()


def token_chunks(documents: DataFrame, flag: Column | None = None, words_a_chunk: int = CHUNK_WORDS, buckets: bool = False) -> DataFrame:
    """documents(doc_id bigint, text) -> the table of chunks, written to the shared folder. A null text has no words. In ``buckets`` of chunk, as many as shuffle partitions, it is not shuffled to meet its answers."""
    # bytes.lower() and bytes.split() follow ASCII rules, which are those of the words.
    rows = documents.select(F.col("doc_id").cast("long"), (F.lit(False) if flag is None else flag).alias("flag"), F.col("text").cast("binary"))
    made = map_batches(rows, partial(_chunks, words_a_chunk=words_a_chunk), COLUMNS)
    if buckets:
        return materialize_buckets(made, "chunks", "chunk", max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    return materialize(made, "chunks")


class Chunk:
    """A row of the table, unpacked."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.docs, self.nulls = unplanes(row["docs"], np.int64), np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.flags, self.lengths = np.frombuffer(row["flags"], np.uint8).astype(bool), unplanes(row["lengths"], np.uint32).astype(np.int64)
        self.tokens, self.vocab = unplanes(zstandard.decompress(row["tokens"]), np.uint32), np.frombuffer(row["vocab"], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def doc_ids(self) -> pa.Array:
        return pa.array(self.docs, mask=self.nulls)


def shards_for(items: int, a_shard: int = 2_000_000) -> int:
    return max(1, -(-int(items) // a_shard))
