"""Language-model scores from an Elias-Fano n-gram trie of the corpus.

The model is an interpolated bigram model with absolute discounting over words and an end token for each text:

    p1(w)   = (c(w) - d1) / N, and d1 * V / N for all unknown words together
    p(w|u)  = (c(uw) - D) / c(u) + D * T(u) / c(u) * p1(w), and p1(w) where u has no training context

with c counts, N tokens, V distinct tokens, T(u) distinct followers of u, all over all training texts; d1 = n1 / (n1 + 2 n2). The first text
position has the start as its context.

The trie is sharded by context. A shard holds its contexts (Elias-Fano over their hashes), monotone pointers to the followers, the followers as
(context's place, fingerprint) so that one ascending Elias-Fano sequence serves all contexts, and the discounted probabilities in 16 bits,
rounded down so that no context sums to more than 1. It is written to a file, memory-mapped, and asked by successor search relative to the place of the
context. Questions are the distinct bigrams of each chunk of the corpus (see token_chunks), which also carry the training counts: a shard is
built from the same rows that ask it. A context with more than its share of all tokens is spread over shards by follower; each shard tells how many
followers it holds, and T(u) is the sum over all shards, whichever of them a chunk asks. There are at most four such contexts a shard and the start.

Words are compared by 64-bit hashes, followers of a context in a shard by 40 bits of them: of a million followers in one shard less than one pair is
expected to be taken for one another.

Nulls: a null text is the empty text, whose only token is the end. Null ids are kept and count as training. Repeated rows count as often as they
occur. Without training texts the only known probability is that of the unknown, 1. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import token_chunks as chunked
from .arrow import map_batches
from .common import load, materialize
from .elias_fano import EliasFano
from .language_id import held_out
from .token_chunks import Chunk, mix, planes, shards_for, unplanes

token_chunks = partial(chunked.token_chunks, buckets=True)

START, END = np.uint64(1), np.uint64(2)
DISCOUNT = 0.75
#: log10 of the smallest probability that 16 bits tell from 0, and the steps down to it.
FLOOR, STEPS = -14.0, 65534
PRINT_BITS = np.uint64(40)


class NgramTrie:
    """Contexts, pointers, followers and 16-bit probabilities of one shard."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, followers: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.followers, self.codes = contexts, pointers, followers, codes

    @classmethod
    def build(cls, contexts: np.ndarray, prints: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> NgramTrie:
        """Rows (context hash, follower fingerprint, training count, c(context) or 0 if it is the sum of the rows), in any order; equal pairs add up."""
        names, place = np.unique(contexts, return_inverse=True)
        pairs, at = np.unique((place.astype(np.uint64) << PRINT_BITS) | prints, return_inverse=True)
        count = np.bincount(at, counts, len(pairs))
        total = np.zeros(len(names))
        np.maximum.at(total, place, totals)
        total = np.where(total > 0, total, np.bincount(place, counts, len(names)))
        pairs, count = pairs[count > 0], count[count > 0]
        owner = (pairs >> PRINT_BITS).astype(np.int64)
        log = np.log10((count - DISCOUNT) / total[owner])
        codes = (1 + np.clip(np.ceil(log / FLOOR * STEPS), 0, STEPS)).astype(np.uint16)
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))]).astype(np.uint64)
        return cls(EliasFano.build(names, 1 << 64), EliasFano.build(starts, len(pairs) + 1), EliasFano.build(pairs, max(len(names), 1) << int(PRINT_BITS)), codes)

    def save(self, path: str) -> None:
        levels = [self.contexts, self.pointers, self.followers]
        parts = [p for level in levels for p in level.parts()] + [self.codes.view(np.uint8)]
        head = np.array([x for level in levels for x in (level.n, level.width)] + [len(p) for p in parts], np.int64)
        with open(path, "wb") as f:
            f.write(head.tobytes())
            for p in parts:
                f.write(p.tobytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        data = np.memmap(path, np.uint8, "r")
        head = np.frombuffer(data[: 13 * 8].tobytes(), np.int64)
        cuts = 13 * 8 + np.concatenate([[0], np.cumsum(head[6:])])
        part = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        levels = [EliasFano(int(head[2 * i]), int(head[2 * i + 1]), part[2 * i], part[2 * i + 1]) for i in range(3)]
        return cls(*levels, np.frombuffer(part[6], np.uint16) if len(part[6]) else np.zeros(0, np.uint16))

    def ask(self, contexts: np.ndarray, runs: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts with the lengths of their runs of followers -> codes of the followers (0: none), followers in all of each context."""
        place = self.contexts.find(contexts)
        known = place >= 0
        types = np.zeros(len(contexts), np.int64)
        types[known] = (self.pointers.access(place[known] + 1) - self.pointers.access(place[known])).astype(np.int64)
        of = np.repeat(place, runs)
        codes = np.zeros(len(prints), np.uint16)
        asked = np.flatnonzero(of >= 0)
        at = self.followers.find((of[asked].astype(np.uint64) << PRINT_BITS) | prints[asked])
        codes[asked[at >= 0]] = self.codes[at[at >= 0]]
        return codes, types


def mapped(trie: NgramTrie) -> NgramTrie:
    """The trie from a memory-mapped file, which lives as long as the mapping."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    try:
        trie.save(path)
        return NgramTrie.open(path)
    finally:
        os.unlink(path)


def _word_order(chunk: Chunk, shards: int):
    shard = (chunk.vocab % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


WORDS = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64())])


def _ask_words(batches, shards: int):
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            train = np.repeat(~chunk.flags, chunk.lengths)
            count = np.bincount(chunk.tokens[train], minlength=len(chunk.vocab)).astype(np.uint32)
            order, cuts = _word_order(chunk, shards)
            # A message for each shard that has any of the words; the first also tells of the texts.
            for s in sorted({0, *np.flatnonzero(np.diff(cuts)).tolist()}):
                own = order[cuts[s] : cuts[s + 1]]
                texts = int((~chunk.flags).sum()) if s == 0 else 0
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([s, row["chunk"], chunk.vocab[own].tobytes(), planes(count[own]), texts], WORDS.types, strict=True)], schema=WORDS)


COUNTS = "chunk long, shard int, counts binary, tokens_seen long, types_seen long, once long, twice long, texts long"


def _count_words(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate([unplanes(r["counts"], np.uint32) for r in rows]).astype(np.float64)).astype(np.uint64)
    cuts = np.cumsum([0, *map(len, hashes)])
    out = {"chunk": [], "shard": [], "counts": []}
    for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True):
        out["chunk"].append(r["chunk"]), out["shard"].append(r["shard"]), out["counts"].append(planes(total[place[a:b]]))
    nothing = [None] * len(rows)
    stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), sum(r["texts"] for r in rows)]
    types = [pa.int64(), pa.int32(), pa.binary()] + [pa.int64()] * 5
    columns = [out["chunk"] + [None], out["shard"] + [None], out["counts"] + [None], *([*nothing, s] for s in stats)]
    names = ["chunk", "shard", "counts", "tokens_seen", "types_seen", "once", "twice", "texts"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class Corpus:
    """Totals over the training texts."""

    def __init__(self, row, shards: int, pair_shards: int):
        self.texts, self.shards, self.pair_shards = row["texts"] or 0, shards, pair_shards
        self.tokens = (row["tokens_seen"] or 0) + self.texts
        self.types = (row["types_seen"] or 0) + (self.texts > 0)
        once, twice = (row["once"] or 0) + (self.texts == 1), (row["twice"] or 0) + (self.texts == 2)
        self.discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, count - self.discount, self.discount * self.types) / self.tokens


class Pairs:
    """The distinct bigrams of a chunk, by shard: where each token's bigram is, and what to ask."""

    def __init__(self, row: dict, rows: list[dict], corpus: Corpus):
        self.chunk = chunk = Chunk(row)
        order, cuts = _word_order(chunk, corpus.shards)
        answers = {r["shard"]: r["counts"] for r in rows if r["counts"] is not None}
        count = np.zeros(len(chunk.vocab), np.int64)
        for s in range(corpus.shards):
            if cuts[s] < cuts[s + 1]:
                count[order[cuts[s] : cuts[s + 1]]] = unplanes(answers[s], np.uint64).astype(np.int64)
        n = len(chunk.vocab)
        # Local numbers n and n + 1 are the start and the end; both occur once in every training text.
        self.count = np.concatenate([count, [corpus.texts, corpus.texts]])
        hashes = mix(np.concatenate([chunk.vocab, [START, END]]))
        size = chunk.lengths + 1
        self.first = np.cumsum(size) - size
        total = int(size.sum())
        words = np.full(total, n + 1, np.int64)
        inner = np.ones(total, bool)
        inner[self.first + chunk.lengths] = False
        words[inner] = chunk.tokens
        context = np.empty(total, np.int64)
        context[1:] = words[:-1]
        context[self.first] = n
        self.words = words
        key, self.place = np.unique(context * (n + 2) + words, return_inverse=True)
        self.context, self.word = key // (n + 2), key % (n + 2)
        self.trained = np.bincount(self.place[np.repeat(~chunk.flags, size)], minlength=len(key)).astype(np.uint32)
        self.hot = self.count * 4 * corpus.pair_shards > corpus.tokens
        spread = hashes[self.context] + np.where(self.hot[self.context], mix(hashes[self.word]), np.uint64(0))
        shard = (spread % np.uint64(corpus.pair_shards)).astype(np.int64)
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.searchsorted(shard[self.order], np.arange(corpus.pair_shards + 1))
        self.hashes = hashes

    def shard(self, s: int):
        """(bigrams, contexts, runs): a shard's bigrams and the runs of a context among them."""
        own = self.order[self.cuts[s] : self.cuts[s + 1]]
        context = self.context[own]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(own) else np.zeros(0, np.int64)
        return own, context[starts], np.diff(np.concatenate([starts, [len(own)]]))


ASK = "shard int, chunk long, contexts binary, runs binary, totals binary, prints binary, trained binary"
ASK_SCHEMA = pa.schema([("shard", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("contexts", "runs", "totals", "prints", "trained")])


def _ask_pairs(counts: pa.Table, chunk: pa.Table, corpus: Corpus) -> pa.Table:
    pairs = Pairs(chunk.to_pylist()[0], counts.to_pylist(), corpus)
    out = []
    for s in np.flatnonzero(np.diff(pairs.cuts)).tolist():
        own, contexts, runs = pairs.shard(s)
        prints = (pairs.hashes[pairs.word[own]] >> (np.uint64(64) - PRINT_BITS)).view(np.uint8).reshape(-1, 8)[:, :5]
        # A context that is not spread adds up to its count in its shard.
        totals = np.where(pairs.hot[contexts], pairs.count[contexts], 0)
        out.append((s, pairs.chunk.chunk, pairs.hashes[contexts].tobytes(), planes(runs.astype(np.uint32)), planes(totals), prints.T.tobytes(), planes(pairs.trained[own])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ASK_SCHEMA.types, strict=True)], schema=ASK_SCHEMA)


ANSWERS = "chunk long, shard int, codes binary, types binary, spread array<struct<context:bigint,types:bigint>>"


def _read_prints(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).reshape(-1)


def _answer_pairs(table: pa.Table) -> pa.Table:
    """A row for each chunk; in one without a chunk, the shard's number of followers of each context that is spread."""
    rows = table.to_pylist()
    asked = [(np.frombuffer(r["contexts"], np.uint64), unplanes(r["runs"], np.uint32), unplanes(r["totals"], np.int64), _read_prints(r["prints"]), unplanes(r["trained"], np.uint32)) for r in rows]
    contexts = np.concatenate([np.repeat(c, n) for c, n, *_ in asked])
    totals = np.concatenate([np.repeat(t, n) for _, n, t, *_ in asked])
    prints, trained = np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked]).astype(np.float64)
    trie = mapped(NgramTrie.build(contexts, prints, trained, totals))
    out = []
    for r, (c, n, _, p, _) in zip(rows, asked, strict=True):
        codes, types = trie.ask(c, n, p)
        out.append((r["chunk"], r["shard"], planes(codes), planes(types.astype(np.uint64)), None))
    spread = np.unique(contexts[totals > 0])
    types = trie.ask(spread, np.zeros(len(spread), np.int64), np.zeros(0, np.uint64))[1]
    told = [{"context": c, "types": t} for c, t in zip(spread.view(np.int64).tolist(), types.tolist(), strict=True)]
    out.append((None, rows[0]["shard"], None, None, told))
    pair = pa.list_(pa.struct([("context", pa.int64()), ("types", pa.int64())]))
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("codes", pa.binary()), ("types", pa.binary()), ("spread", pair)])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(table: pa.Table, own: pa.Table, corpus: Corpus, spread: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """spread: hashes of the contexts that are spread over shards, ascending, and their followers in all shards."""
    rows = table.to_pylist()
    pairs = Pairs(own.to_pylist()[0], rows, corpus)
    chunk, count = pairs.chunk, pairs.count
    codes, types = np.zeros(len(pairs.context), np.uint16), np.zeros(len(count), np.int64)
    for r in rows:
        if r["codes"] is not None:
            own, contexts, _ = pairs.shard(r["shard"])
            codes[own] = unplanes(r["codes"], np.uint16)
            types[contexts] = unplanes(r["types"], np.uint64).astype(np.int64)
    over = np.unique(pairs.context[pairs.hot[pairs.context]])
    types[over] = spread[1][np.searchsorted(spread[0], pairs.hashes[over])]
    base = np.log10((count + 1) / (corpus.tokens + corpus.types + 1))
    lower = corpus.word_probability(count)[pairs.word]
    seen = count[pairs.context]
    upper = np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) / STEPS * FLOOR), 0.0)
    p = np.where(seen > 0, upper + DISCOUNT * types[pairs.context] / np.maximum(seen, 1) * lower, lower)
    add = lambda x: np.add.reduceat(x, pairs.first) if len(pairs.first) else x[:0]
    data = [
        chunk.doc_ids(), pa.array(chunk.flags), pa.array(chunk.lengths + 1), pa.array(add((count[pairs.words] > 0).astype(np.int64))),
        pa.array(np.full(len(chunk.docs), corpus.tokens)), pa.array(add(base[pairs.words])), pa.array(add(np.log10(p)[pairs.place])),
    ]
    return pa.table(data, names=[c.split()[0] for c in SCORES.split(", ")])


def score_texts(documents: DataFrame, flag: Column) -> DataFrame:
    """documents(doc_id bigint, text), ``flag``: which rows are held out -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = token_chunks(documents, flag)
    size = chunks.agg(F.sum("words").alias("words"), F.sum(F.octet_length("vocab") / 8).alias("vocab")).first()
    shards, pair_shards = shards_for(size["vocab"] or 1), shards_for(size["words"] or 1)
    asked = map_batches(chunks, partial(_ask_words, shards=shards), "shard int, chunk long, hashes binary, counts binary, texts long")
    counts = materialize(asked.groupBy("shard").applyInArrow(lambda key, t: _count_words(t), COUNTS), "counts")
    stats = ("tokens_seen", "types_seen", "once", "twice", "texts")
    corpus = Corpus(counts.filter("chunk IS NULL").agg(*(F.sum(c).alias(c) for c in stats)).first(), shards, pair_shards)
    counts = counts.filter("chunk IS NOT NULL").select("chunk", "shard", "counts")
    # Chunks are in buckets, so only counts and answers are shuffled to them.
    own = chunks.groupBy("chunk")
    pairs = counts.groupBy("chunk").cogroup(own).applyInArrow(lambda key, t, chunk: _ask_pairs(t, chunk, corpus), ASK)
    answers = materialize(pairs.groupBy("shard").applyInArrow(lambda key, t: _answer_pairs(t), ANSWERS), "answers")
    # At most 4 * pair_shards + 1 contexts come to the driver.
    told = answers.filter("chunk IS NULL").select(F.explode("spread").alias("s")).groupBy("s.context").agg(F.sum("s.types").alias("types")).toArrow()
    hashes = told.column("context").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    spread = hashes[order], told.column("types").to_numpy()[order]
    answers = answers.filter("chunk IS NOT NULL").drop("spread")
    told = counts.unionByName(answers, allowMissingColumns=True).groupBy("chunk")
    return told.cogroup(own).applyInArrow(lambda key, t, chunk: _score(t, chunk, corpus, spread), SCORES)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7))
