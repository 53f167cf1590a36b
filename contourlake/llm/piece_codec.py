"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model has a whitespace marker behind another character, so merges never cross the start of a marker run: a text is cut there, each
distinct chunk of the whole corpus is segmented once, and the ids are joined back by position. The result equals the library's own on the whole text; a
model with crossing pieces is refused.

1. Documents are numbered: a row holds some whole documents as numbers of their words; its distinct words (bounded in number) go to the shards of their hashes,
   packed, one message for each shard that has any.
2. The distinct-chunk table: in its shard a word is segmented once, however many rows ask for it.
3. Ids go back to the rows that asked, and from there to the documents by position; a row decodes each of its distinct words once.

A text of any length is encoded whole. A null text is the empty text, with begin and end ids only. Rows are independent, so
null keys, ties, repeated rows and empty tables need no rule; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import freed, map_batches, record_batch, slices
from .common import load, materialize_buckets
from .token_chunks import Numbers, planes, unplanes

MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Words and distinct words after which a row of numbered documents ends.
ROW_WORDS, ROW_DISTINCT = 3_000_000, 400_000
#: Distinct words that the library gets at a time.
STEP = 4096


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross whitespace markers")
    return sp


def chunks_of(text: str) -> list[str]:
    """The text's chunks, each without its first marker (the one that encode() puts before a text)."""
    if not text:
        return []
    if MARK not in text and "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(" " + text)]


def pack_strings(words: pa.Array) -> bytes:
    """An array of strings without nulls, compressed."""
    sizes = pc.binary_length(words.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.uint32)
    return zstandard.compress(len(words).to_bytes(4, "little") + planes(sizes) + b"".join(words.cast(pa.binary()).to_pylist()), 6)


def unpack_strings(data: bytes) -> pa.Array:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.concatenate([[0], np.cumsum(unplanes(data[4 : 4 + 4 * n], np.uint32).astype(np.int64))])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[4 + 4 * n :])])


NUMBERED = "row long, shard int, docs binary, nulls binary, lengths binary, tokens binary, words binary"


def _number(batches, shards: int):
    """Documents as numbers of their words (shard null), and a message of the row's words for each shard that has any; numbers are by shard, then word."""
    import xxhash
    from pyspark import TaskContext

    schema = pa.schema([("row", pa.int64()), ("shard", pa.int32())] + [(c, pa.binary()) for c in ("docs", "nulls", "lengths", "tokens", "words")])
    part, made = TaskContext.get().partitionId(), 0
    docs, nulls, tokens, numbers, held = [], [], [], Numbers(), 0

    def packed():
        words = list(numbers)
        shard = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ids = np.concatenate([np.zeros(0, np.uint32), *tokens])
        lengths = np.fromiter(map(len, tokens), np.uint32, len(tokens))
        row = (part << 32) + made
        yield record_batch([[row], [None], [planes(np.array(docs, np.int64))], [np.array(nulls, np.uint8).tobytes()], [planes(lengths)], [_pack_tokens(ids, place)], [None]], schema)
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = pa.array([words[i] for i in order[cuts[s] : cuts[s + 1]]], pa.string())
            yield record_batch([[row], [int(s)], *[[None]] * 4, [pack_strings(own)]], schema)

    for batch in slices(batches, 1):
        for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            words = chunks_of(text)
            docs.append(doc or 0), nulls.append(doc is None)
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            held += len(words) + 1
            if held >= ROW_WORDS or len(numbers) >= ROW_DISTINCT:
                yield from packed()
                docs, nulls, tokens, numbers, held, made = [], [], [], Numbers(), 0, made + 1
    if docs:
        yield from packed()


def _pack_tokens(ids: np.ndarray, place: np.ndarray) -> bytes:
    """Numbers by first occurrence, so that a first occurrence is told by one code (0) and frequent words are small; then each number's place."""
    codes = ids + np.uint32(1)
    # A first occurrence is above all that came before.
    codes[np.concatenate([np.ones(min(len(ids), 1), bool), ids[1:] > np.maximum.accumulate(ids)[:-1]])] = 0
    return zstandard.compress(len(place).to_bytes(4, "little") + planes(place) + planes(codes), 3)


def _unpack_tokens(data: bytes) -> np.ndarray:
    """The place of each word of the documents."""
    data = zstandard.decompress(data)
    end = 4 + 4 * int.from_bytes(data[:4], "little")
    place, codes = unplanes(data[4:end], np.uint32), unplanes(data[end:], np.uint32)
    first = np.flatnonzero(codes == 0)
    codes = codes - np.uint32(1)
    codes[first] = np.arange(len(first), dtype=np.uint32)
    return place[codes] if len(codes) else np.zeros(0, np.uint32)


PIECES = "row long, shard int, sizes binary, ids binary"


def segment(sp, words: list[str]) -> list[list[int]]:
    """ids of chunks."""
    return [x or [sp.piece_to_id(MARK)] for x in sp.encode(words, num_threads=1)]


def _segment(table: pa.Table, path: str) -> pa.Table:
    """The messages of a shard, answered; each of its words is segmented once."""
    sp = processor(path)
    rows = table.select(["row", "shard", "words"]).to_pylist()
    asked = [unpack_strings(r["words"]) for r in rows]
    coded = pa.concat_arrays(asked).dictionary_encode()
    names, which, cuts = coded.dictionary, coded.indices.to_numpy(), np.cumsum([0, *map(len, asked)])
    del asked
    sizes, ids = np.zeros(len(names), np.uint32), []
    for at in range(0, len(names), STEP):
        found = segment(sp, names.slice(at, STEP).to_pylist())
        sizes[at : at + STEP] = [len(x) for x in found]
        ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(sizes[at : at + STEP].sum())))
    flat, first = np.concatenate(ids), np.cumsum(sizes, dtype=np.int64) - sizes
    out = []
    for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
        own = which[a:b]
        n = sizes[own].astype(np.int64)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append((r["row"], r["shard"], zstandard.compress(planes(sizes[own]), 3), zstandard.compress(planes(flat[np.repeat(first[own], n) + inside]), 3)))
    schema = pa.schema([("row", pa.int64()), ("shard", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _join_back(numbered: pa.Table, answers: pa.Table, path: str, hashed: bool) -> pa.Table:
    """One row of numbered documents with the pieces of its words -> a row for each document."""
    sp = processor(path)
    row, answers = numbered.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["shard"])
    ids, words = [], []
    for r in answers:
        n = unplanes(zstandard.decompress(r["sizes"]), np.uint32)
        flat = unplanes(zstandard.decompress(r["ids"]), np.uint32)
        data, cuts = flat.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).tolist()
        ids += [data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for at in range(0, len(n), STEP):
            part = cuts[at : at + STEP + 1]
            numbers = flat[part[0] : part[-1]].tolist()
            # The marker alone decodes to nothing, like the one in front of a text.
            words += sp.decode([numbers[a - part[0] : b - part[0]] for a, b in zip(part[:-1], part[1:], strict=True)], num_threads=1)
    begin, end = (x.to_bytes(4, "little") for x in (sp.bos_id(), sp.eos_id()))
    tokens = _unpack_tokens(row["tokens"])
    cuts = np.concatenate([[0], np.cumsum(unplanes(row["lengths"], np.uint32).astype(np.int64))]).tolist()
    own = pa.array(unplanes(row["docs"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
    coded, decoded = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        doc = tokens[a:b].tolist()
        coded.append(begin + b"".join([ids[i] for i in doc]) + end)
        text = " ".join([words[i] for i in doc])
        decoded.append(hashlib.sha256(text.encode()).hexdigest() if hashed else text)
    return pa.table({"row": own, "ids": pa.array(coded, pa.binary()), "decoded": pa.array(decoded, pa.string())})


def encode_texts(docs: DataFrame, key: str = "doc_id", path: str | None = None, hashed: bool = False) -> DataFrame:
    """docs(key bigint, text) -> key, ids (little-endian uint32, begin and end included), decoded (``hashed``: its SHA-256 in hex)."""
    path, spark = path or model_path(), docs.sparkSession
    # As many shards as shuffle partitions, which grow with the data; messages without words are not sent.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(key).cast("long").alias("row"), "text")
    numbered = materialize_buckets(map_batches(rows, partial(_number, shards=shards), NUMBERED), "numbered", "row", shards)
    pieces = numbered.filter("shard IS NOT NULL").select("row", "shard", "words").groupBy("shard").applyInArrow(lambda key, table: freed(_segment, table, path), PIECES)
    own = numbered.filter("shard IS NULL").drop("shard", "words")
    back = pieces.groupBy("row").cogroup(own.groupBy("row"))
    out = back.applyInArrow(lambda key, answers, numbered: freed(_join_back, numbered, answers, path, hashed), "row long, ids binary, decoded string")
    return out.withColumnRenamed("row", key)


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    out = encode_texts(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
