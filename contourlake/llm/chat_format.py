"""Chat formatting: turns of a conversation to one marked string, with a loss mask over what the assistant says.

Turn structs are collected and sorted, adjacent turns of a role are merged by array functions, and the string is concatenated,
all in Spark expressions. The template of a block of one role is ``[INST]role[/INST]text([SEP]text)*</s>``, and every formatted
conversation starts with ``<s>``. Inside roles and texts a backslash is doubled and a control string gets a backslash after its first
character, so no control string occurs in a text, and reading back is exact: split at ``</s>``, ``[/INST]``, ``[SEP]``, then drop one
level of backslashes. ``loss_spans`` are places in that string (start and end in code points, end exclusive): one for each assistant text.
Work and memory of a conversation grow with its length (running sums and cuts: with its length to the power 1.5, in small steps).

Nulls: a null text or role is the empty string. A null conv_id is a conversation of its own. Rows sort by turn (null first),
then role, then text, so ties and repeated rows have one order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]"]


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        c = F.replace(c, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(array: Column, n: Column) -> Column:
    """The array cut into runs of about the square root of its length, so that work on every prefix of a run stays far from quadratic."""
    step = F.ceil(F.sqrt(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda k: F.slice(array, k * step + 1, step))


def _sums(numbers: Column, base: Column) -> Column:
    """base, and base plus the sum of the numbers up to each."""
    state = F.struct(base.alias("sum"), F.array(base).alias("all"))
    added = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
    return F.aggregate(numbers, state, added, lambda a: a["all"])


def starts_of(lengths: Column) -> Column:
    """Where each of the pieces of these lengths begins when they stand end to end."""
    total = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x)
    within = lambda run, base: F.slice(_sums(run, base), F.lit(1), F.size(run))
    bases = lambda runs: F.slice(_sums(F.transform(runs, total), F.lit(0).cast("long")), F.lit(1), F.size(runs))
    return let(lengths, lambda own: let(_runs(own, F.size(own)), lambda runs: F.flatten(F.zip_with(runs, bases(runs), within))))


def spans_text(text: Column, spans: Column) -> Column:
    """What stands in ``text`` under the spans (start, end in code points, ascending): an array of strings."""
    cut = lambda run, low: lambda part: F.transform(run, lambda s: part.substr((s["start"] - low + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    def of_run(whole: Column):
        def body(run: Column) -> Column:
            low, high = F.get(run, F.lit(0))["start"], F.get(run, F.size(run) - 1)["end"]
            return let(low, lambda a: let(whole.substr((a + 1).cast("int"), (high - a).cast("int")), cut(run, a)))

        return body

    found = let(text, lambda whole: let(spans, lambda own: F.flatten(F.transform(_runs(own, F.size(own)), of_run(whole)))))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<string>"))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, blocks, formatted, loss_spans."""
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    # Every lambda below names bound arrays only: a field of ``t`` named inside one would be built anew for each element.
    def blocks(roles: Column, texts: Column) -> Column:
        """Adjacent turns of a role, merged: each block is a slice between two positions where the role changes."""
        at = F.filter(F.sequence(F.lit(1), F.size(roles)), lambda i: (i == 1) | (F.get(roles, i - 1) != F.get(roles, i - 2)))
        return let(
            F.concat(at, F.array(F.size(roles) + 1)),
            lambda s: F.transform(
                F.sequence(F.lit(0), F.size(s) - 2),
                lambda k: F.struct(F.get(roles, F.get(s, k) - 1).alias("role"), F.slice(texts, F.get(s, k), F.get(s, k + 1) - F.get(s, k)).alias("texts")),
            ),
        )

    chats = chats.withColumn("blocks", let(F.col("t.role"), lambda roles: let(F.col("t.text"), lambda texts: blocks(roles, texts)))).drop("t")
    # Each text with what stands before it: the head of its block (behind the end of the one before), or a separator.
    start = F.struct(F.lit("<s>").alias("head"), F.lit("").alias("text"), F.lit(False).alias("loss"))
    piece = lambda b, k: lambda x, i: F.struct(
        F.when(i > 0, F.lit("[SEP]")).otherwise(F.concat(F.when(k > 0, F.lit("</s>")).otherwise(F.lit("")), F.lit("[INST]"), escape(b["role"]), F.lit("[/INST]"))).alias("head"),
        escape(x).alias("text"),
        (b["role"] == loss_role).alias("loss"),
    )
    pieces = F.concat(F.array(start), F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], piece(b, k)))))

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: (F.length(x["head"]) + F.length(x["text"])).cast("long"))
        placed = F.zip_with(p, starts_of(lengths), lambda x, at: F.struct(x["loss"].alias("loss"), (at + F.length(x["head"])).alias("start"), (at + F.length(x["head"]) + F.length(x["text"])).alias("end")))
        return F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    out = let(
        pieces,
        lambda p: F.struct(F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["text"])), ""), F.lit("</s>")).alias("formatted"), spans(p).alias("loss_spans")),
    )
    return chats.withColumn("_o", out).select("conv_id", "blocks", F.col("_o.formatted").alias("formatted"), F.col("_o.loss_spans").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns in a formatted string, original texts restored."""
    blocks = F.transform(
        F.filter(F.split(F.substring(formatted, 4, 2_147_483_647), "</s>"), lambda b: b != ""),
        lambda b: F.split(F.substring(b, 7, 2_147_483_647), r"\[/INST\]", 2),
    )
    return F.flatten(
        F.transform(
            blocks, lambda b: F.transform(F.split(b[1], r"\[SEP\]"), lambda x: F.struct(unescape(b[0]).alias("role"), unescape(x).alias("text")))
        )
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    chats = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_chats(chats).withColumn("turns", read_back(F.col("formatted")))
    loss = let(F.array_join(spans_text(F.col("formatted"), F.col("loss_spans")), ""), unescape)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[SEP]', '[\SEP]') AS et,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[SEP]', '[\SEP]') AS er,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (3 + sum(length(et) + CASE WHEN same THEN 5 ELSE length(er) + 17 END))::BIGINT AS formatted_chars,
  sum(CASE WHEN same THEN 0 ELSE 1 END)::BIGINT AS n_blocks
FROM e GROUP BY conv_id
"""
