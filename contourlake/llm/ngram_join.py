"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's set holds the hashes of its distinct n-word shingles (with fewer words: of the whole sequence; without words: nothing). Two documents
link when ``100 * |intersection| >= percent * |union|``; a link's documents share at least ``ceil(percent * n / 100)`` shingles, n the size of either
set, so under any order of all shingles they share one among the first ``n - that + 1`` of each.

1. Frequencies: in how many distinct sets of a chunk, summed over chunks, each shingle occurs. Every order puts rare shingles first.
2. A set of which too few shingles occur anywhere else has no partner and stops here. Equal sets are one class.
3. Candidates share a prefix shingle under the first order. Each class is first compared with one other, the least class of the shingle groups that it
   shares most of, if their prefixes under the further orders meet too: that ties a group of thousands of near copies together by as many comparisons as it has members.
4. What is left are shingle groups with classes of several components. Their classes are sorted by the component that they were compared with and cut into blocks of bounded size; two
   blocks are a task if a shingle group has classes of different components in them. A task intersects the filters of components, sizes and all orders and counts
   the common shingles of what is left, as products of 0/1 matrices over slices of the shingles that both sides have. It returns a spanning forest, never its pairs.

All counts cover the whole input; nothing is capped or sampled.

Nulls: a null or wordless text has an empty set, links with nothing and is its own component. A null id takes the component of its class but is no
node. Rows that share an id are one node that has the links of all its texts. Repeated rows each keep a row; an empty table gives none. Other columns
are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import freed, map_batches
from .common import discard, global_before, load, materialize, maybe_broadcast
from .graph import connected_components, least_reachable
from .token_chunks import Chunk, mix, shards_for, token_chunks

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: One odd factor for each further order of the shingles.
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
FINGERPRINT = np.uint64((1 << 40) - 1)


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i's set is hashes[bounds[i]:bounds[i + 1]], ascending."""
    words = mix(chunk.vocab)[chunk.tokens]
    sizes = np.where(chunk.lengths >= n, chunk.lengths - n + 1, np.minimum(chunk.lengths, 1))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + chunk.starts[doc]
    span = np.minimum(chunk.lengths[doc], n)
    total = np.zeros(len(doc), np.uint64)
    for j in range(n):
        on = span > j
        total[on] = (total[on] + words[at[on] + j]) * FACTOR
    hashes = mix(total + span.astype(np.uint64))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, doc = hashes[first], doc[first]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))])


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each document's set; equal sets have equal ones."""
    run = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    sums = [run(x) for x in (mix(hashes * FACTOR), mix(hashes ^ ORDERS[0]))]
    return np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)


def chunk_items(chunk: Chunk, n: int, shards: int):
    """What a chunk asks: sets, digests, the first document of each distinct set, its distinct shingles by (shard, fingerprint), in how many of those sets."""
    hashes, bounds = shingle_sets(chunk, n)
    digests = set_digests(hashes, bounds)
    _, firsts = np.unique(digests, axis=0, return_index=True)
    firsts = np.sort(firsts[np.diff(bounds)[firsts] > 0])
    keep = np.zeros(len(bounds) - 1, bool)
    keep[firsts] = True
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    used = keep[doc]
    shard = hashes % np.uint64(shards)
    key = (shard << np.uint64(40)) | ((hashes // np.uint64(shards)) & FINGERPRINT)
    distinct, place, count = np.unique(key[used], return_inverse=True, return_counts=True)
    return hashes, bounds, digests, firsts, doc, used, distinct, place, count


def _ask(batches, n: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            *_, distinct, _, count = chunk_items(Chunk(row), n, shards)
            cuts = np.searchsorted(distinct, np.arange(shards + 1, dtype=np.uint64) << np.uint64(40))
            # Empty messages are not sent, so there are no more of them than items.
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                prints = np.ascontiguousarray((distinct[own] & FINGERPRINT).view(np.uint8).reshape(-1, 8)[:, :5])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([row["chunk"]]), pa.array([prints.T.tobytes()], pa.binary()), pa.array([np.minimum(count[own], 255).astype(np.uint8).tobytes()], pa.binary())], schema=schema)


def _read_prints(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).reshape(-1)


def _frequencies(table: pa.Table) -> pa.Table:
    """For each chunk of a shard a code for each of its shingles: 0 for one that occurs nowhere else, else growing with the logarithm."""
    rows = table.to_pylist()
    prints = [_read_prints(r["prints"]) for r in rows]
    _, place = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(place, np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]))
    code = np.where(total < 2, 0, np.minimum(255, 8 * np.log2(np.maximum(total, 2)) - 7)).astype(np.uint8)[place]
    cuts = np.cumsum([0, *map(len, prints)])
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("codes", pa.binary())])
    return pa.table([pa.array([r["chunk"] for r in rows]), pa.array([r["shard"] for r in rows], pa.int32()), pa.array([code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)


SET_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("whole", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("further", pa.list_(pa.list_(pa.int64())))]
)
SET_COLUMNS = "doc_id long, digest binary, n long, whole array<long>, first array<long>, further array<array<long>>"


def _prefixes(table: pa.Table, n: int, percent: int, shards: int) -> pa.Table:
    """A row for each document; one document of each set that may have partners carries the set and its prefixes."""
    rows = table.to_pylist()
    chunk = Chunk(next(r for r in rows if r["shard"] is None))
    hashes, bounds, digests, firsts, _, used, _, place, _ = chunk_items(chunk, n, shards)
    codes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["codes"], np.uint8) for r in sorted((r for r in rows if r["shard"] is not None), key=lambda r: r["shard"]))])
    code = np.zeros(len(hashes), np.uint8)
    code[used] = codes[place]
    sizes = np.diff(bounds)
    shared = np.concatenate([[0], np.cumsum(code > 0)])
    shared = shared[bounds[1:]] - shared[bounds[:-1]]
    need = -(-percent * sizes // 100)
    whole, first, further = ([None] * len(sizes) for _ in range(3))
    for i in firsts[shared[firsts] >= need[firsts]]:
        own, rare = hashes[bounds[i] : bounds[i + 1]], code[bounds[i] : bounds[i + 1]]
        length, found = sizes[i] - need[i] + 1, []
        for factor in (np.uint64(1), *ORDERS):
            prefix = np.lexsort((own * factor, rare))[:length]
            found.append(own[prefix[rare[prefix] > 0]].view(np.int64))
        if all(map(len, found)):
            whole[i], first[i], further[i] = own.view(np.int64), found[0], found[1:]
    data = [chunk.doc_ids(), [d.tobytes() for d in digests], sizes, whole, first, further]
    return pa.table([d if isinstance(d, pa.Array) else pa.array(d, t) for d, t in zip(data, SET_SCHEMA.types, strict=True)], schema=SET_SCHEMA)


#: Bounds of a block: classes, and shingles in all but of its last class.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 200_000
#: Columns of a product's slice.
SLICE = 4096


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every element of a list column."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def _common(rows: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """How many values each row of ``left`` has in common with each of ``right``."""
    place = [np.full(n, -1), np.full(n, -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    sides = [(p[rows[p[rows] >= 0]], values[p[rows] >= 0]) for p in place]
    shared = np.intersect1d(*(v for _, v in sides))
    total = np.zeros((len(left), len(right)), np.float32)
    kept = []
    for row, value in sides:
        at = np.searchsorted(shared, value)
        inside = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == value) if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[inside], kind="stable")
        kept.append((row[inside][order], at[inside][order]))
    for start in range(0, len(shared), SLICE):
        parts = []
        for (row, at), size in zip(kept, total.shape, strict=True):
            lo, hi = np.searchsorted(at, (start, start + SLICE))
            part = np.zeros((size, min(SLICE, len(shared) - start)), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def _link(key, table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links between classes of two blocks that are of different components."""
    one, two = (k.as_py() for k in key)
    table = table.sort_by("id")
    ids, sizes, block, tied = (table.column(c).to_numpy() for c in ("id", "n", "block", "tied"))
    n, left, right = len(ids), np.flatnonzero(block == one), np.flatnonzero(block == two)
    near = 100 * np.minimum(sizes[left][:, None], sizes[right]) >= percent * np.maximum(sizes[left][:, None], sizes[right])
    near &= tied[left][:, None] != tied[right]
    if one == two:
        near &= left[:, None] < right
    for order in ("first", *(f"further{i}" for i in range(len(ORDERS))), "whole"):
        i, j = near.any(axis=1), near.any(axis=0)
        left, right, near = left[i], right[j], near[np.ix_(i, j)]
        common = _common(*_lists(table.column(order)), left, right, n)
        near &= common > 0
    both = sizes[left][:, None] + sizes[right]
    a, b = np.nonzero(near & (100 * common >= percent * (both - common)))
    low = least_reachable(left[a], right[b], n)
    hung = np.flatnonzero(low != np.arange(n))
    return pa.table({"a": pa.array(ids[low[hung]], pa.int64()), "b": pa.array(ids[hung], pa.int64())})


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents(doc_id bigint, text) -> doc_id, n_shingles, component_id."""
    chunks = token_chunks(documents)
    shards = shards_for(chunks.agg(F.sum("words")).first()[0] or 1)
    asked = map_batches(chunks, partial(_ask, n=n, shards=shards), "shard int, chunk long, prints binary, counts binary")
    codes = materialize(asked.groupBy("shard").applyInArrow(lambda key, t: freed(_frequencies, t), "chunk long, shard int, codes binary"), "codes")
    told = chunks.withColumn("shard", F.lit(None).cast("int")).withColumn("codes", F.lit(None).cast("binary")).unionByName(codes, allowMissingColumns=True)
    found = materialize(told.groupBy("chunk").applyInArrow(lambda key, t: freed(_prefixes, t, n, percent, shards), SET_COLUMNS), "sets")
    docs = materialize(found.select("doc_id", "digest", "n"), "digests")
    classes = docs.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id")).filter("id IS NOT NULL")
    sets = found.filter("whole IS NOT NULL").select("digest", "n", "whole", "first", *(F.get("further", F.lit(i)).alias(f"further{i}") for i in range(len(ORDERS))))
    sets = materialize(sets.dropDuplicates(["digest"]).join(classes, "digest").drop("digest"), "candidates")
    discard(chunks, codes, found)
    prefixes = materialize(sets.select(F.explode("first").alias("token"), "id"), "prefixes")
    least = prefixes.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("token", "least")
    shared = materialize(prefixes.join(least, "token"), "shared")
    # Sets that share no prefix shingle have no partner.
    candidates, sets = sets, materialize(sets.join(maybe_broadcast(shared.select("id").distinct()), "id", "left_semi"), "partners")
    discard(candidates, prefixes)
    # One comparison for each class: with the class that is the least of most of its groups, ties to the smaller.
    most = shared.filter("id <> least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("c")).groupBy("id").agg(F.max_by("least", F.struct("c", -F.col("least"))).alias("least"))
    most = materialize(most, "nearest")
    # Prefixes under the further orders travel as the upper halves of their hashes, which can only let more pairs through.
    halves = lambda side: [F.transform(f"further{i}", lambda x: F.shiftright(x, 32).cast("int")).alias(f"{side}{i}") for i in range(len(ORDERS))]
    own = sets.select(F.col("id"), F.col("n").alias("n1"), F.col("whole").alias("w1"), *halves("l"))
    other = sets.select(F.col("id").alias("least"), F.col("n").alias("n2"), F.col("whole").alias("w2"), *halves("r"))
    alike = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    # Every order's filter, before whole sets are compared.
    for i in range(len(ORDERS)):
        alike = alike & F.arrays_overlap(f"l{i}", f"r{i}")
    common = F.size(F.array_intersect("w1", "w2"))
    compared = own.join(maybe_broadcast(most), "id").join(other, "least").filter(alike).select(F.col("least").alias("a"), F.col("id").alias("b"), "n1", "n2", common.alias("c"))
    stars = materialize(compared.filter(F.col("c") * 100 >= (F.col("n1") + F.col("n2") - F.col("c")) * percent).select("a", "b"), "stars")
    tied = materialize(connected_components(stars).select(F.col("node").alias("id"), F.col("component").alias("tied")), "tied")
    # Groups that still hold classes of several components, and the blocks of their classes.
    mixed = materialize(shared.select("token", "id").join(tied, "id", "left").withColumn("tied", F.coalesce("tied", "id")), "grouped")
    open_groups = mixed.groupBy("token").agg(F.min("tied").alias("low"), F.max("tied").alias("high")).filter("low < high").select("token")
    grouped = materialize(mixed.join(open_groups, "token"), "open")
    discard(mixed)
    # A class stands beside the component of the class that it was compared with, so that those of common groups share blocks.
    beside = most.join(tied.select(F.col("id").alias("least"), F.col("tied").alias("near")), "least", "left").select("id", F.coalesce("near", "least").alias("near"))
    members = grouped.select("id", "tied").distinct().join(beside, "id", "left").withColumn("place", F.coalesce(F.when(F.col("tied") == F.col("id"), F.col("near")), "tied"))
    members = members.select("id", "tied", "place").join(sets.select("id", "n"), "id")
    members = global_before(members, [F.col("place"), F.col("tied"), F.col("id")], {"_rows": F.lit(1), "_shingles": F.col("n")}, "order")
    block = (F.floor(F.col("_rows") / BLOCK_CLASSES) + F.floor(F.col("_shingles") / BLOCK_SHINGLES)).alias("block")
    members = materialize(members.select("id", "tied", block), "blocks")
    placed = materialize(grouped.join(members.select("id", "block"), "id"), "placed")
    touched = placed.groupBy("token", "block").agg(F.min("tied").alias("low"), F.max("tied").alias("high"))
    left, right = (touched.select("token", F.col("block").alias(b), F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")) for b in ("one", "two"))
    several = (F.least("low_one", "low_two") < F.greatest("high_one", "high_two")) & (F.col("one") <= F.col("two"))
    pairs = left.join(right, "token").filter(several).select("token", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    # Of a block only the classes go to a task that share a group with the other one.
    sides = materialize(pairs.join(placed.select("token", "block", "id"), ["token", "block"]).select("one", "two", "id").distinct(), "sides")
    tasks = members.join(sets, "id").join(sides, "id")
    links = materialize(tasks.groupBy("one", "two").applyInArrow(lambda key, t: _link(key, t, percent), "a long, b long"), "links")
    labels = connected_components(stars.unionByName(links))
    discard(sets, shared, most, grouped, members, placed, sides, links, stars, tied)
    known = classes.join(labels, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = docs.join(known, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), n=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2
"""
