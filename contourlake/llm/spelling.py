"""Spelling variants: words one edit apart, found by a rare-first prefix filter of positional bigrams.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased; of a text's runs a known share loses one letter, chosen by a hash of the row and
the run (``thin``). Kept are those of ``least`` code points and ``support`` occurrences or more.

1. Every task counts the words of its texts in a table of bounded size; partial counts are added up by Spark.
2. Bigrams are ordered by how often they occur in the kept words, rare ones first. Letters are 90, so the order has 8,100 entries at most.
3. One edit touches two bigrams of a word at most, so of the three rarest of each of two words one edit apart, one is in both, at places that differ by one at most
   (where the third is followed by itself, that place counts with it). Such a bigram has the edit on one side: everything on the other side is equal, and so is one half of its own. A join key is the
   bigram's place, the shorter word's length, and what must be equal; a word asks as the shorter or equal one and as the longer one.
4. The join's condition verifies that the distance is one, so it gives links only. Keys hold at least about half of a word, so few words share one.

A word's form is its near word with most occurrences (of equals the least in code-point order), if that has ``ratio`` times its own or more. Along forms counts grow by that
factor, so chains are short, and roots are found by doubling.

Nulls: a null text has no words; a row with a null id loses no letter. Equal rows count as often as they occur. Texts and words of any length are whole. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, slices
from .common import discard, load, materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters of a text that are looked at together, distinct words and letters of them that a task holds.
PART, WORDS, LETTERS = 1 << 22, 200_000, 1 << 23


def text_words(doc: int | None, text: str, thin: int) -> Counter:
    """The words of a text, before any is dropped for its length."""
    found: Counter = Counter()
    runs = (m[0] for m in RUN.finditer(text)) if len(text) > PART else iter(RUN.findall(text.encode("utf-8", "surrogatepass").translate(LOWERED).decode("utf-8", "surrogatepass")))
    own = Counter(runs)
    begun = crc32(b"%d:" % doc) if doc is not None else None
    for run, n in own.items():
        if len(text) > PART:
            run = run.encode().translate(LOWERED).decode()
        if begun is not None and (h := crc32(run.encode(), begun)) % thin == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def _count(batches, least: int, thin: int):
    schema, total, letters = pa.schema([("word", pa.string()), ("n", pa.int64())]), Counter(), 0
    for batch in slices(batches, 1):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in text_words(doc, text, thin).items():
                if len(word) >= least:
                    letters += len(word) if word not in total else 0
                    total[word] += n
            if len(total) >= WORDS or letters >= LETTERS:
                yield from _told(total, schema)
                total, letters = Counter(), 0
    yield from _told(total, schema)


def _told(total: Counter, schema: pa.Schema):
    rows = iter(total.items())
    while some := list(islice(rows, 20_000)):
        yield record_batch([list(c) for c in zip(*some, strict=True)], schema)


def count_words(documents: DataFrame, least: int = 6, support: int = 5, thin: int = 199) -> DataFrame:
    """documents(doc_id, text) -> word, n."""
    rows = documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    found = map_batches(rows, partial(_count, least=least, thin=thin), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)


def _bigrams(word: bytes) -> np.ndarray:
    letters = np.frombuffer(word, np.uint8).astype(np.int64)
    return letters[:-1] * 256 + letters[1:]


def _frequencies(batches):
    """(bigram, n): a row for each bigram of the task's words."""
    schema, total = pa.schema([("bigram", pa.int32()), ("n", pa.int64())]), np.zeros(1 << 16, np.int64)
    for batch in batches:
        for word in batch.column(0).to_pylist():
            np.add.at(total, _bigrams(word.encode("latin-1")), 1)
    seen = np.flatnonzero(total)
    yield record_batch([pa.array(seen, pa.int32()), pa.array(total[seen])], schema)


def bigram_order(words: DataFrame) -> np.ndarray:
    """The rank of each bigram (two letters of 8 bits), rare ones first; those that do not occur come first of all."""
    rows = map_batches(words.select("word"), _frequencies, "bigram int, n long").groupBy("bigram").agg(F.sum("n").alias("n"))
    count = np.zeros(1 << 16, np.int64)
    for bigram, n in rows.collect():  # 8,100 rows at most
        count[bigram] = n
    rank = np.empty(1 << 16, np.int32)
    rank[np.lexsort((np.arange(1 << 16), count))] = np.arange(1 << 16)
    return rank


def rarest(word: bytes, rank: np.ndarray, most: int = 3) -> list[int]:
    """Places of the rarest bigrams, of equal ones the first, and the place after the last of them if the same bigram stands there too.

    Of two words take the one whose last is the earlier by (rank, place). What the edit leaves of its bigrams is in the other at most one place later, so at or before that
    one's last, or just after it.
    """
    own = rank[_bigrams(word)]
    last = np.lexsort((np.arange(len(own)), own))[min(most, len(own)) - 1]
    return np.flatnonzero((own < own[last]) | ((own == own[last]) & (np.arange(len(own)) <= last + 1))).tolist()


def link_keys(word: bytes, places: list[int]) -> tuple[set[int], set[int]]:
    """(keys as the shorter or equal word, keys as the longer one)."""

    def key(side: bytes, n: int, p: int, *equal: bytes) -> int:
        return xxhash.xxh3_64_intdigest(b"%b%d,%d," % (side, n, p) + b"|".join(equal)) - (1 << 63)

    n, own, longer = len(word), set(), set()
    for p in places:
        # What follows the bigram, and what stands before it, in halves: the edit is in one of the four.
        h = (n - p - 2) // 2
        own |= {key(b"a", n, p, word[: p + 2 + h]), key(b"b", n, p, word[: p + 2], word[p + 2 + h :])}
        own |= {key(b"c", n, p, word[: p // 2], word[p:]), key(b"d", n, p, word[p // 2 :])}
        if p + 3 <= n:
            h = (n - p - 3) // 2
            longer |= {key(b"a", n - 1, p, word[: p + 2 + h]), key(b"b", n - 1, p, word[: p + 2], word[p + 3 + h :])}
        if p:
            h = (p - 1) // 2
            longer |= {key(b"c", n - 1, p - 1, word[:h], word[p:]), key(b"d", n - 1, p - 1, word[h + 1 :])}
    return own, longer


def _ask(batches, rank: np.ndarray):
    schema = pa.schema([("key", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
    for batch in slices(batches, 0):
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            letters = word.encode("latin-1")
            if len(letters) > 1:
                for longer, keys in enumerate(link_keys(letters, rarest(letters, rank))):
                    rows += [(k, bool(longer), word, n) for k in keys]
            if rows and (len(rows) >= 20_000 or len(word) > 10_000):
                yield record_batch([list(c) for c in zip(*rows, strict=True)], schema)
                rows = []
        if rows:
            yield record_batch([list(c) for c in zip(*rows, strict=True)], schema)


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), words of four letters or more -> word, n, near, near_n: all pairs one insertion, deletion or replacement apart, in both directions."""
    asked = materialize(map_batches(words.select("word", "n"), partial(_ask, rank=bigram_order(words)), "key long, longer boolean, word string, n long"), "spelling-keys")
    # A key that no two rows share asks in vain.
    own = asked.filter("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    other = asked.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("bn"))
    one_apart = F.levenshtein("a", "b", 1) == 1
    links = own.join(other, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & one_apart).select("a", "an", "b", "bn").distinct()
    links = materialize(links, "spelling-links")
    discard(asked)
    return links.toDF("word", "n", "near", "near_n").unionByName(links.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")))


def follow(forms: DataFrame) -> DataFrame:
    """forms(word, form), no cycles -> word, root: the last word along forms, by doubling."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(step.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(step)
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return step


def spelling_variants(documents: DataFrame, least: int = 6, support: int = 5, ratio: int = 5, thin: int = 199) -> DataFrame:
    """documents(doc_id, text) -> word, n, n_near, form, form_n, root; a row for each kept word. ``least`` must be 4 or more."""
    if least < 4 or ratio < 2:
        raise ValueError("least must be 4 or more, ratio 2 or more")
    words = materialize(count_words(documents, least, support, thin), "spelling-words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    known = materialize(words.join(near, "word", "left"), "spelling-near")
    fits = F.col("form_n") >= F.col("n") * ratio
    roots = follow(known.filter(fits).select("word", "form"))
    discard(words)
    out = known.join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"), F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents"))


# The same words by CRC-32 over bytes; near words by one letter left out, which is another way than the operator's.
OP12_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY 1, 2),
bytes AS (SELECT doc_id, run, c, hex(encode(doc_id || ':' || run)) AS x FROM own),
hashed AS (SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda h, b: xor(h >> 8, crc.t[(xor(h, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
kept AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, c FROM hashed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE len(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, unnest(range(0, len(word))) t(i)),
pairs AS (
  SELECT DISTINCT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(l := -near_n, w := near)) AS b FROM pairs GROUP BY 1),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.l >= 5 * w.n THEN b.w END AS form, CASE WHEN -b.l >= 5 * w.n THEN -b.l END AS form_n FROM w LEFT JOIN best USING (word)),
walk(word, now, d) AS (SELECT word, word, 0 FROM known UNION ALL SELECT walk.word, known.form, d + 1 FROM walk JOIN known ON known.word = walk.now WHERE known.form IS NOT NULL)
SELECT known.word, known.n, known.n_near::BIGINT AS n_near, known.form, known.form_n, r.root FROM known JOIN (SELECT word, arg_max(now, d) AS root FROM walk GROUP BY 1) r USING (word)
"""
