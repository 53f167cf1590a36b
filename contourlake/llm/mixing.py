"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all tokens; a target
stops at ``cap`` times its source's tokens and the excess is shared anew by weight until none is above.

Schedule: slot k is mapped by its van der Corput point (bits of k reversed) through the cumulative targets to a source, and the
slots of a source are ranked. Each source's documents are shuffled by a seeded hash and laid end to end; block j is
tokens ``j * block .. (j + 1) * block`` of that stream. The slot of rank r takes the source's r-th block, from the
start again after the last one. A source takes slots until its target is reached, the last one in part; a source of which
the sequence has too few points gets its missing slots after all others.

Scale: the text is read once, for sizes. Running sums are hierarchical (hash buckets of a source, chunks of the slots), so a source
with a third of all rows is spread like the others. Pieces and slots meet in an equi-join on (source, block), each with a
bounded number of rows on either side: at most ``block`` pieces, at most ``ceil(cap) + 1`` slots.

Nulls: a null text has size 0; null sources are one source, null ids are kept. Documents of size 0 are never taken. Equal rows get equal
treatment, and each of them a row. Empty tables give no rows. Other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_before, load, materialize, maybe_broadcast, running_before, word_count

WEIGHTS = (3, 1, 2)
#: Rows that a hash bucket of a source is meant to hold.
BUCKET_ROWS = 4096
#: Slots ranked by one window.
SLOT_CHUNK = 65536
#: 53 bits keep sums and ratios exact.
UNIT = float(1 << 53)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, size) -> src (rank), source, n, source_size, weight, target: one row for each source."""
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    sources = global_before(sources, [F.col("source").asc_nulls_last()], {"src": F.lit(1)}, "mix-sources").withColumn("src", (F.col("src") + 1).cast("long"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    # Water filling: sources fill up in the order of cap / weight, so the level is found at the first that stays below its cap.
    sources = sources.withColumn("_ratio", F.col("source_size") / F.col("weight"))
    sources = materialize(global_before(sources, [F.col("_ratio").asc(), F.col("src").asc()], {"_size": F.col("source_size"), "_weight": F.col("weight")}, "mix-order"), "mix-filled")
    totals = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    full = F.col("source_size") * F.lit(float(cap))
    # What is left for the sources from here on, and their weight.
    left = F.lit(float(totals["size"] or 0)) * F.lit(float(share)) - F.col("_size") * F.lit(float(cap))
    open_weight = F.lit(totals["weight"] or 0) - F.col("_weight")
    below = sources.select("_ratio", "src", left.alias("left"), open_weight.alias("open")).filter(F.col("open") > 0).join(sources.select("src", "weight", full.alias("full")), "src")
    level = below.filter("left * weight <= full * open").agg(F.min(F.struct("_ratio", "src", "left", "open")).alias("l")).first()["l"]
    target = full if level is None else F.least(F.lit(level["left"]) * F.col("weight") / F.lit(level["open"]), full)
    return sources.withColumn("target", target).drop("_ratio", "_size", "_weight")


def van_der_corput(k: Column) -> Column:
    """Bits of k reversed behind the binary point: 0, 1/2, 1/4, 3/4, 1/8 ..., exact for k below 2^52."""
    bits = F.bin(k)
    return F.conv(F.reverse(bits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(bits))


def block_schedule(targets: DataFrame, block: int) -> DataFrame:
    """targets(src, source_size, target) -> slot, src, rank, epoch, block, take: which block each slot takes, and how much of it."""
    spark = targets.sparkSession
    need = targets.filter("source_size > 0 AND target > 0").select(
        "src", "source_size", F.round("target").cast("long").alias("quota"), F.ceil(F.col("source_size") / block).cast("long").alias("blocks")
    )
    need = materialize(global_before(need, [F.col("src").asc()], {"_lo": F.col("quota")}, "mix-need").withColumn("_hi", F.col("_lo") + F.col("quota")), "mix-quota")
    totals = need.agg(F.sum("quota").alias("q"), F.count(F.lit(1)).alias("n")).first()
    total, n = totals["q"] or 0, totals["n"]
    # Slots that a source needs: whole passes over its blocks (the last block of a pass may be short) and the rest.
    rest = F.col("quota") % F.col("source_size")
    need = need.withColumn("slots", F.floor(F.col("quota") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block))
    points = -(-total // block) + n
    # Sources by cells of the unit interval: an equi-join finds the source of a point.
    cells = max(4 * n, 1)
    spans = need.select("src", (F.col("_lo") / total).alias("lo"), (F.col("_hi") / total).alias("hi")) if total else need.select("src", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    drawn = spark.range(points).select(F.col("id").alias("k"), van_der_corput(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = drawn.join(maybe_broadcast(spans), "cell").filter("u >= lo AND u < hi").select("k", "src", F.floor(F.col("k") / SLOT_CHUNK).alias("chunk"))
    ranked = running_before(drawn, ["src"], "chunk", [F.col("k")], F.lit(1), "rank").select("src", "rank", "k")
    # Every slot that a source needs, with its place in the sequence where it has one.
    step = 1 << 12
    wanted = need.withColumn("_c", F.explode(F.expr(f"sequence(0L, cast((greatest(slots, 1) - 1) div {step} as bigint))")))
    wanted = wanted.withColumn("rank", F.explode(F.expr(f"sequence(_c * {step}, least(slots, (_c + 1) * {step}) - 1)"))) .filter("slots > 0")
    slots = wanted.join(ranked, ["src", "rank"], "left")
    epoch, at = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - at * block)
    return slots.select(
        F.coalesce(F.col("k"), F.lit(points) + F.col("rank")).alias("slot"), "src", "rank", epoch.alias("epoch"), at.alias("block"),
        F.least(length, F.col("quota") - epoch * F.col("source_size") - at * block).alias("take"),
    )


def document_pieces(docs: DataFrame, targets: DataFrame, block: int, seed: int) -> DataFrame:
    """docs(doc_id, source, size) -> doc_id, src, size, start (its place in the shuffled stream), block, lo, hi (tokens of that block)."""
    ranks = maybe_broadcast(targets.select("source", "src", "n", "source_size").withColumnRenamed("source", "_s"))
    placed = docs.join(ranks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The shuffle key: a seeded hash in [0, 2^53), its leading part the bucket.
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 11)
    placed = placed.withColumn("_h", key).withColumn("_b", F.floor(F.col("_h") / UNIT * F.ceil(F.col("n") / BUCKET_ROWS)))
    placed = running_before(placed, ["src"], "_b", [F.col("_h"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0).cast("long"))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    return pieces.select("doc_id", "src", "size", "start", "block", lo.alias("lo"), hi.alias("hi"))


def mix_sources(documents: DataFrame, block: int = 2048, seed: int = 1, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0):
    """documents(doc_id, text, source) -> (mix, schedule, pieces).

    mix: doc_id, source, size, source_size, target, taken. schedule: :func:`block_schedule`. pieces: :func:`document_pieces`. Training
    order: ``schedule`` joined with ``pieces`` on (src, block), by slot.
    """
    docs = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(docs, weights, share, cap), "mix-targets")
    schedule = materialize(block_schedule(targets, block), "mix-slots")
    pieces = materialize(document_pieces(docs, targets, block, seed), "mix-pieces")
    # A block is taken by a few slots at most; they add up before the join's rows do.
    joined = pieces.join(schedule.select("src", "block", "take"), ["src", "block"])
    words = F.greatest(F.least("hi", "take") - F.col("lo"), F.lit(0).cast("long"))
    taken = joined.groupBy("src", "start", "doc_id", "size").agg(F.sum(words).alias("taken"))
    untaken = pieces.select("src", "start", "doc_id", "size").distinct().join(taken, ["src", "start"], "left_anti").withColumn("taken", F.lit(0).cast("long"))
    known = maybe_broadcast(targets.select("src", "source", "source_size", "target"))
    mix = taken.select("src", "doc_id", "size", "taken").unionByName(untaken.select("src", "doc_id", "size", "taken")).join(known, "src")
    empty = docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumnRenamed("source", "_s")
    empty = empty.join(known, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return mix.select(*columns).unionByName(empty.select(*columns)), schedule, pieces


def training_order(schedule: DataFrame, pieces: DataFrame) -> DataFrame:
    """src, start, doc_id, size, epoch, words, slot: of each time that a document comes round, the words taken and the slot that it begins in."""
    joined = pieces.join(schedule.select("src", "block", "epoch", "take", "slot"), ["src", "block"])
    words = F.greatest(F.least("hi", "take") - F.col("lo"), F.lit(0).cast("long"))
    joined = joined.withColumn("words", words).filter("words > 0")
    return joined.groupBy("src", "start", "doc_id", "size", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    mix, _, _ = mix_sources(load(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
