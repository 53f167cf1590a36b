"""Sharding: a minimax contiguous partition of atomic groups.

Rows of equal texts are one group, which is never split. Groups stand in the order of a 60-bit digest of their text, so neighbours are unrelated and the order
depends on nothing but the texts. The smallest capacity that lets ``shards`` shards hold all groups in that order is found by binary search, each try
checked greedily: a shard takes groups until the next one would not fit. Of the partitions of that capacity the one whose smallest shard is largest is
taken, to a thousandth, so that a group larger than a fair share does not leave shards empty. The law is ``bytes``.

The search never sees all groups. It begins with the sums of a bounded number of cells of the digest; cells bound the capacity from above (cut only between
cells) and from below (cut anywhere inside a cell of several groups), and only cells that can hold a cut of some capacity between the bounds are split
further, until both bounds are one. The driver holds ``CELLS`` sums at most for each round. A shard is then a comparison of a row's digest with the cuts:
no join and no shuffle. Slots are places in a range-partitioned order, so neither a shard nor a group with a third of all rows is one task.

Sizes: UTF-8 bytes and one. A null text has no bytes, so it is of the group of the empty text, and its CRC-32 is 0. Null ids are kept. Repeated rows each get a
slot; which of two equal rows gets which is not defined. Fewer groups than shards leave shards empty; an empty table gives no rows. Two texts of one digest
would share a shard. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, global_before, load, materialize

#: Bits of the digest, and of the cells that the search begins with.
BITS, FIRST = 60, 12
#: Cells that a round of the search makes, at most.
CELLS = 1 << 16
#: Steps of the search for the largest smallest shard.
BALANCE = 10


def text_group(text: Column) -> Column:
    """The group of a text: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _borders(total: list[int], capacity: int, shards: int) -> list[int]:
    """Where a greedy check cuts, as places in the running totals; it ends early where an item is too large."""
    cuts, at = [], 0
    for _ in range(shards):
        at = max(at, bisect_right(total, total[at] + capacity) - 1)
        cuts.append(at)
    return cuts


def _liquid(total: list[int], atom: list[bool], capacity: int, shards: int) -> list[int]:
    """The same where items that are no atoms can be cut anywhere: the sums before each cut, which no real cut passes."""
    cuts, done = [], 0
    for _ in range(shards):
        goal = done + capacity
        at = bisect_right(total, goal) - 1
        done = total[-1] if goal >= total[-1] else max(done, total[at]) if atom[at] else goal
        cuts.append(done)
    return cuts


def _least(low: int, high: int, fits) -> int:
    """The least whole number from low to high that fits; high does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def _balanced(total: list[int], capacity: int, shards: int) -> list[int]:
    """Places of the cuts of a partition of that capacity whose smallest shard is about as large as can be."""

    def reach(least: int) -> list[list[bool]] | None:
        """For each number of shards, the borders that can end it with every shard between the bounds."""
        rows = [[True] + [False] * (len(total) - 1)]
        for _ in range(shards):
            before, seen, row, low, high = rows[-1], [0], [], 0, 0
            for x in before:
                seen.append(seen[-1] + x)
            for t in total:
                while total[low] < t - capacity:
                    low += 1
                while high < len(total) and total[high] <= t - least:
                    high += 1
                row.append(seen[high] > seen[low] if high > low else False)
            rows.append(row)
        return rows if rows[-1][-1] else None

    low, found = 0, reach(0)
    high = total[-1] // shards
    for _ in range(BALANCE):
        mid = (low + high + 1) // 2
        rows = reach(mid) if mid > low else None
        low, high, found = (mid, high, rows) if rows else (low, max(mid - 1, low), found)
    cuts, at = [], len(total) - 1
    for row in found[-2:0:-1]:
        # From the end backwards: of the borders that lead on, the one nearest to an even share of what is before it.
        first, last = bisect_left(total, total[at] - capacity), bisect_right(total, total[at] - low) - 1
        share = total[at] * (shards - 1 - len(cuts)) // (shards - len(cuts))
        at = min((i for i in range(first, last + 1) if row[i]), key=lambda i: (abs(total[i] - share), i))
        cuts.append(at)
    return cuts[::-1]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """groups(grp, bytes) -> (least capacity, the first digest of each shard but the first; 2^60 where a shard is empty)."""
    least = None
    # Items in order: first digest, bits below it, bytes, whether one group.
    items, todo, width = [], [(0, BITS)], BITS - FIRST
    while todo:
        old = todo[0][1]
        cell = F.shiftright("grp", width).alias("cell")
        rows = groups
        if old < BITS:
            # At most CELLS rows.
            wanted = groups.sparkSession.createDataFrame([(start >> old,) for start, _ in todo], "wanted long")
            rows = rows.join(F.broadcast(wanted), F.shiftright("grp", old) == F.col("wanted"), "left_semi")
        sums = rows.groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest")).orderBy("cell").collect()
        gone = {start for start, _ in todo}
        items = sorted([x for x in items if x[0] not in gone or x[1] != old] + [(r["cell"] << width, width, int(r["bytes"]), r["n"] == 1) for r in sums])
        if not items:
            return 0, [1 << BITS] * (shards - 1)
        total = [0, *accumulate(x[2] for x in items)]
        if least is None:
            least = max(-(-total[-1] // shards), max(r["largest"] for r in sums))
        atom = [x[3] for x in items] + [True]
        high = _least(least, total[-1], lambda c: _borders(total, c, shards)[-1] == len(items))
        least = _least(least, high, lambda c: _liquid(total, atom, c, shards)[-1] == total[-1])
        todo = []
        if least < high:
            # The k-th cut of a capacity between the bounds lies between these two.
            for low, far in zip(_borders(total, least, shards), _liquid(total, atom, high, shards), strict=True):
                todo += [i for i in range(low, bisect_left(total, far)) if not items[i][3]]
            todo = sorted({(items[i][0], items[i][1]) for i in todo})
            # Cells of one width at a time, the widest first.
            old = max(w for _, w in todo)
            todo = [x for x in todo if x[1] == old][: CELLS >> 1]
            width = max(0, old - max(1, (CELLS // len(todo)).bit_length() - 1))
    starts = [x[0] for x in items] + [1 << BITS]
    return high, [starts[i] for i in _balanced(total, high, shards)]


def shard_of(group: Column, cuts: list[int]) -> Column:
    """The shard of a group: how many cuts are at or below its digest."""
    return sum((F.when(group >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """documents(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; a row for each row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), text_group(F.col("text")).alias("grp"))
    # Equal rows are told apart by their place in this table, so that they too spread over tasks.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    placed = rows.withColumn("shard", shard_of(F.col("grp"), cuts))
    # A row for each shard.
    sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    before = [0, *accumulate(sizes.get(s, 0) for s in range(shards - 1))]
    placed = global_before(placed, [F.col("grp"), F.xxhash64("doc_id"), F.col("_row")], {"_at": F.lit(1)}, "shard-order")
    discard(rows, groups)
    slot = F.col("_at") - F.element_at(F.array(*(F.lit(b) for b in before)), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = 8, files: int = 1) -> None:
    """``documents`` as Parquet folders ``shard=0`` and so on, all columns kept, groups together and in order; ``files`` parts or so for each shard."""
    groups = documents.groupBy(text_group(F.col("text")).alias("grp")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("bytes"))
    kept = materialize(groups, "shard-groups")
    _, cuts = minimax_cuts(kept, shards)
    discard(kept)
    names = [f"_shard_{i}" for i in range(3)]
    rows = documents.withColumns({names[0]: text_group(F.col("text")), names[2]: F.xxhash64("doc_id")})
    rows = rows.withColumn("shard", shard_of(F.col(names[0]), cuts))
    order = ["shard", names[0], names[2]]
    rows.repartitionByRange(shards * files, *order).sortWithinPartitions(*order).drop(names[0], names[2]).write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))
