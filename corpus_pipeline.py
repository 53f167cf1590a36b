"""From raw documents to token ids: language, near-duplicates, secrets, mixture, pieces.

Every stage takes all rows that its predecessor kept and returns the columns of ``documents``, the last one the encoded texts. Between stages the
rows are written as Parquet to the shared folder and read again.

Nulls: a null text has no language and goes in the first stage. A row with a null doc_id is never dropped as a near-duplicate, as no decision can name it, and
is one row with all that have no id and its text in the mixture, taken as often as they are together. Rows that repeat an id and its text count once after the second stage. A null lang is not learned from, a null
source is a source of its own, n_chars follows the text. Empty tables give no rows; further columns of the input are left out at the start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm.common import load, materialize, maybe_broadcast, scratch, shared_dir
from contourlake.llm.language_id import fit_language_model, keep_languages
from contourlake.llm.mixing import mix_sources, training_order
from contourlake.llm.ngram_join import jaccard_components
from contourlake.llm.piece_codec import encode_texts
from contourlake.llm.secrets import redact_secrets, scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is known; learned from the labelled ones among them."""
    docs = docs.select(*COLUMNS)
    return keep_languages(docs, fit_language_model(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 or more, directly or through others, the one of the smallest id."""
    docs = docs.select(*COLUMNS)
    with scratch(spark) as keep:
        # A table of its own: the groups are read more than once.
        groups = keep(jaccard_components(docs, n=5, percent=80), "groups")
    dropped = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(maybe_broadcast(dropped), "doc_id", "left_anti")
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    docs = docs.select(*COLUMNS)
    ledger = scan_secrets(docs, f"{shared_dir(spark)}/contourlake/ledger-{uuid.uuid4().hex}")
    return redact_secrets(docs, ledger).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture's schedule, each as often as it comes round: not at all, once or twice.

    A document counts where at least half of its words are taken; a pass over a source ends within one document, so that is all that is rounded.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))))
    with scratch(spark) as keep:
        _, schedule, parts = mix_sources(docs.select(F.col("_key").alias("doc_id"), "text", "source"))
        order = training_order(schedule, parts).filter("2 * words >= size").select("src", "start", F.col("doc_id").alias("_key"), "slot")
        order = keep(order, "order")
    # Rows of one id and text are the same row as often as they occur: one of them stands for all.
    repeated = docs.groupBy("_key").count().filter("count > 1").select("_key")
    if not repeated.isEmpty():
        once = docs.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        docs = docs.join(repeated, "_key", "left_anti").unionByName(once)
    taken = docs.join(maybe_broadcast(order), "_key")
    return taken.repartitionByRange("slot", "src", "start").sortWithinPartitions("slot", "src", "start").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32, begin and end included), ids_sha256, decoded_sha256."""
    out = encode_texts(docs, hashed=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("pieces", pieces),
]

#: SQL expresses neither language scores nor pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # Of what a stage writes on its way only its result stays.
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
