"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Training: the words of a bounded sample of the training texts, with a share of it for each language, are cut into pieces of the public vocabulary, counted for each language, and smoothed to piece
probabilities. Scoring: a word's probability in a language is the sum over all its segmentations into pieces of the product
of their probabilities (forward algorithm; a character that is no piece costs a fixed floor), a text's the product over its words, and the score
is the posterior of the best language under its share of all training texts as prior. Ties go to the smaller language code.

Words are runs outside white space, marked in front. The forward algorithm needs the sums of the last few prefixes only, as many as the
longest piece has characters, and rescales them as it goes, so a word of any length is scored whole. Each distinct word of a task is scored once while a bounded table holds it.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0; so is every text if there is nothing to learn from. Rows
without a label are not learned from. Null ids, repeated rows and ties need no rule. Other columns are never read. The labels are a
bounded set: the model is one row of piece probabilities for each.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, slices
from .common import load
from .piece_codec import MARK, model_path, processor

#: Words up to this length are scored together, those of one length at a time; longer ones by a window over their characters. Both sum all segmentations.
BLOCK_CHARS = 24
#: Starts of a long word that pieces are looked up for at a time.
LONG_STEP = 4096
#: Distinct words that a worker holds, and their characters, before it starts anew.
TABLE_ROWS, TABLE_CHARS = 200_000, 8_000_000
#: Labelled rows that a model is learned from, about.
SAMPLE = 65_536
#: Added to the count of every piece.
SMOOTHING = 0.1
#: Log-probability of a character that is not a piece of the vocabulary.
UNKNOWN = float(np.log(1e-7))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FLAG_BITS = 22


def _count_pieces(batches, path: str):
    """(lang, piece, n): piece counts of a task."""
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.int64())])
    sp = processor(path)
    size, words, totals = sp.get_piece_size(), {}, {}

    def settle():
        for lang, counter in words.items():
            known = list(counter)
            into = totals.setdefault(lang, np.zeros(size, np.int64))
            for at in range(0, len(known), 8192):
                part = known[at : at + 8192]
                ids = sp.encode(part, num_threads=1)
                weight = np.repeat([counter[w] for w in part], [len(x) for x in ids])
                into += np.bincount(np.fromiter((i for x in ids for i in x), np.int64, len(weight)), weight, size).astype(np.int64)
        words.clear()

    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in words:
                words[lang] = Counter()
            words[lang].update(text.split())
        if sum(map(len, words.values())) > TABLE_ROWS:
            settle()
    settle()
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield record_batch([[lang] * len(used), used.astype(np.int32), counts[used]], schema)


def shares_of(texts: dict[str, int], sample: int) -> dict[str, float]:
    """Numbers of texts by language -> the share of each to learn from: languages with few give all, the others alike what is left."""
    left, out = sample, {}
    for i, (lang, n) in enumerate(sorted(texts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(texts) - i))
        out[lang], left = take / n, left - take
    return out


def fit_language_model(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> dict:
    """docs(lang, text) -> the model: languages, log-probabilities of pieces by language, log prior. Rows of null lang or text are left out.

    Of more than ``sample`` distinct labelled texts about so many are learned from, whole texts chosen by a hash of the text, with a share for each
    language. Equal texts of a language count once for the pieces; the prior counts all rows.
    """
    rows = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    # A row for each language.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()
    langs = sorted(r["lang"] for r in sizes)
    docs_of = np.array([n for _, n in sorted((r["lang"], r["n"]) for r in sizes)], np.float64)
    shares = shares_of({r["lang"]: max(1, min(r["n"], r["texts"])) for r in sizes}, sample)
    if any(s < 1 for s in shares.values()):
        share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit(9), "text"), 11) <= share * F.lit(float(1 << 53)))
    rows = rows.dropDuplicates(["lang", "text"])
    path = path or model_path()
    # At most a vocabulary of rows for each language come to the driver.
    found = map_batches(rows, partial(_count_pieces, path=path), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    size = processor(path).get_piece_size()
    counts = np.zeros((size, len(langs)))
    counts[found["piece"].to_numpy(np.int64), [langs.index(x) for x in found["lang"]]] = found["n"].to_numpy(np.float64)
    pieces = counts + SMOOTHING
    return {"langs": langs, "pieces": np.log(pieces / pieces.sum(0)).astype(np.float32), "prior": np.log(docs_of / max(docs_of.sum(), 1)), "path": path}


class WordScores:
    """word -> log-probability in every language, summed over all segmentations."""

    def __init__(self, model: dict):
        sp = processor(model["path"])
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [sp.id_to_piece(i) for i in usable]
        self.longest = max(map(len, pieces), default=1)
        # Pieces by a rolling hash of their characters; the flags tell most other strings apart without a search.
        hashes = np.array([self.hash_of(piece) for piece in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[(self.hashes * FACTOR) >> np.uint64(64 - FLAG_BITS)] = True
        self.p = np.exp(np.vstack([model["pieces"].astype(np.float64), np.full((1, len(model["langs"])), UNKNOWN)]))
        self.at: dict[str, int] = {}
        self.held = 0
        self.logs = np.zeros((0, len(model["langs"])))

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids) of the hashes that are those of pieces."""
        maybe = np.flatnonzero(self.flags[(hashes * FACTOR) >> np.uint64(64 - FLAG_BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], self.ids[at[hit]]

    def forward(self, strings: list[str]) -> np.ndarray:
        """Log-probabilities of strings: alpha[i] sums the segmentations of the first i characters."""
        out = np.zeros((len(strings), self.p.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            if len(s) > BLOCK_CHARS:
                out[i] = self.forward_long(s)
            else:
                by_length.setdefault(len(s), []).append(i)
        unknown = self.p[-1]
        for n, members in by_length.items():
            codes = np.array([strings[i] for i in members], f"U{n}").view(np.uint32).reshape(len(members), n).T.astype(np.uint64) + np.uint64(1)
            alpha = np.zeros((n + 1, len(members), self.p.shape[1]))
            alpha[0] = 1
            for start in range(n):
                h = np.zeros(len(members), np.uint64)
                for end in range(start + 1, min(n, start + self.longest) + 1):
                    h = h * FACTOR + codes[end - 1]
                    hit, ids = self.find(h)
                    if end == start + 1:
                        step = np.broadcast_to(unknown, alpha[0].shape).copy()
                        step[hit] = self.p[ids]
                        alpha[end] += alpha[start] * step
                    else:
                        alpha[end, hit] += alpha[start, hit] * self.p[ids]
            out[members] = np.log(np.maximum(alpha[n], 1e-300))
        return out

    def forward_long(self, string: str) -> np.ndarray:
        """The same for one string of any length, LONG_STEP starts at a time: sums of the last prefixes, times e to the power -scale."""
        n, unknown = len(string), self.p[-1]
        codes = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        # sums[j]: the sum for the prefix that ends j characters after the next start.
        sums, scale = np.zeros((self.longest + 1, len(unknown))), np.zeros(len(unknown))
        sums[0] = 1
        for first in range(0, n, LONG_STEP):
            last = min(n, first + LONG_STEP)
            starts, lengths, ids = [], [], []
            h = np.zeros(last - first, np.uint64)
            for length in range(1, min(self.longest, n - first) + 1):
                h = h[: min(last, n - length + 1) - first]
                h = h * FACTOR + codes[first + length - 1 : first + length - 1 + len(h)]
                hit, found = self.find(h)
                starts.append(hit), ids.append(found), lengths.append(np.full(len(hit), length))
            known = np.zeros(last - first, bool)
            known[starts[0]] = True
            start, length, piece = map(np.concatenate, (starts, lengths, ids))
            order = np.argsort(start, kind="stable")
            length, p = length[order], self.p[piece[order]]
            cuts = np.searchsorted(start[order], np.arange(last - first + 1))
            for at in range(last - first):
                own = sums[0].copy()
                if own.min() < 1e-100:
                    # Every language has a scale of its own; no sum is 0, as any character may stand alone.
                    scale += np.log(own)
                    sums /= own
                    own = sums[0].copy()
                a, b = cuts[at], cuts[at + 1]
                sums[length[a:b]] += own * p[a:b]
                if not known[at]:
                    sums[1] += own * unknown
                sums[:-1] = sums[1:]
                sums[-1] = 0
        return np.log(np.maximum(sums[0], 1e-300)) + scale

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > TABLE_ROWS or self.held + sum(map(len, new)) > TABLE_CHARS:
            self.at, self.logs, self.held, new = {}, self.logs[:0], 0, list(words)
        self.held += sum(map(len, new))
        logs = self.forward([MARK + w for w in new])
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.logs = np.vstack([self.logs, logs]) if new else self.logs

    def score(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        at = self.at.__getitem__
        return [self.logs[np.fromiter(map(at, words), np.int64, len(words))].sum(0) for words in split]


def _predict(batches, model: dict):
    schema = pa.schema([("row", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    scores = WordScores(model) if model["langs"] else None
    for batch in slices(batches, 2):
        texts = batch.column(2).to_pylist()
        lettered = [i for i, t in enumerate(texts) if scores and t and any(map(str.isalpha, t))]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for i, logs in zip(lettered, scores.score([texts[i] for i in lettered]) if lettered else [], strict=True):
            logs = logs + model["prior"]
            best = int(np.argmax(logs))
            lang[i], score[i] = model["langs"][best], round(float(1 / np.exp(logs - logs[best]).sum()), 6)
        yield record_batch([batch.column(0), batch.column(1), lang, score], schema)


def predict_language(docs: DataFrame, model: dict, key: str = "doc_id", flag: Column | None = None) -> DataFrame:
    """docs(key bigint, text) -> key, held_out (the flag as given), lang_pred, score."""
    rows = docs.select(F.col(key).cast("long").alias("row"), (F.lit(False) if flag is None else flag).alias("held_out"), "text")
    return map_batches(rows, partial(_predict, model=model), "row long, held_out boolean, lang_pred string, score double").withColumnRenamed("row", key)


def _keep(batches, model: dict, text: str, least: float):
    scores = WordScores(model) if model["langs"] else None
    for whole in batches:
        for batch in slices([whole], whole.schema.get_field_index(text)):
            texts = batch.column(text).to_pylist()
            lettered = [i for i, t in enumerate(texts) if scores and t and any(map(str.isalpha, t))]
            kept = [False] * len(texts)
            for i, logs in zip(lettered, scores.score([texts[i] for i in lettered]) if lettered else [], strict=True):
                logs = logs + model["prior"]
                kept[i] = 1 / np.exp(logs - logs.max()).sum() >= least
            yield batch.filter(pa.array(kept, pa.bool_()))


def keep_languages(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, as they are; null texts and texts without a letter go."""
    return map_batches(docs, partial(_keep, model=model, text=text, least=least), docs.schema)


def held_out(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``, is 2; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"), 4)))
    return predict_language(docs, model, flag=held_out(F.col("doc_id"), 4))
