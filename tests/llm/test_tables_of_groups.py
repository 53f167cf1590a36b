"""Whitening, spelling variants and shards against brute force, with nulls, ties, repeats, long values and empty tables."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.llm import sharding, spelling, whitening

TINY = "/root/testdata/sf0.001"


# Whitening


def test_products_and_sums_are_exact():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(2, 200)) * 10.0 ** r.integers(-8, 8, (2, 200))
    for f, exact in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        for x, y, h, e in zip(a, b, *f(a, b), strict=True):
            assert exact(Fraction(float(x)), Fraction(float(y))) == Fraction(float(h)) + Fraction(float(e))
    big = np.array([1e16, 1.0, -1e16, 3.0, 2.0**-40])[:, None]
    high, low = whitening.total(big, np.zeros_like(big))
    assert Fraction(float(high[0])) + Fraction(float(low[0])) == 4 + Fraction(1, 2**40)


def test_covariance_of_a_far_mean():
    """Outer products in parts of tiles and tasks are those of exact fractions to the last bit or so, though the mean is 1e7 times the spread."""
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(50, 4)) * 10) + 100_000_000
    mean = [Fraction(int(v)) / 50 for v in x.sum(axis=0)]
    pair = tuple(np.array(p) for p in zip(*((float(m), float(m - Fraction(float(m)))) for m in mean), strict=True))
    got = whitening.add(whitening.outer_products(x[:20], pair, tile=7), whitening.outer_products(x[20:], pair))
    want = [sum((Fraction(int(row[i])) - mean[i]) * (Fraction(int(row[j])) - mean[j]) for row in x) for i in range(4) for j in range(i, 4)]
    for h, e, w in zip(*got, want, strict=True):
        assert abs(Fraction(float(h)) + Fraction(float(e)) - w) < Fraction(1, 10**20)


def whole(v):
    return [int(np.floor(1024 * float(c))) + 100_000 for c in v]


def check_whitened(rows, vectors):
    """vectors: (id, components) of those that take part."""
    x = np.array([whole(v) for _, v in vectors])
    n, sums = len(x), x.sum(axis=0)
    k = n * x - sums
    cov = k.T.astype(float) @ k.astype(float) / n**3
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = int((values > 1e-10 * values[0]).sum())
    most = min(8, rank)
    assert Counter(r["vec_id"] for r in rows) == {i: c * most for i, c in Counter(i for i, _ in vectors).items()}
    far = defaultdict(set)
    for (i, _), v in zip(vectors, k, strict=True):
        far[i].add(sum(int(c) ** 2 for c in v))
    assert all(r["deviation"] in far[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9 for r in rows)
    for c in range(1, most + 1):
        own = [r for r in rows if r["component"] == c]
        assert all(abs(r["explained"] - values[c - 1] / np.trace(cov)) < 1e-9 for r in own)
        # Projections: the covariance with x gives back the eigenvector.
        assert abs(np.mean([r["whitened"] ** 2 for r in own]) - 1) < 1e-9
    if len({i for i, _ in vectors}) == n:
        w = np.zeros((n, most))
        place = {i: at for at, (i, _) in enumerate(vectors)}
        for r in rows:
            w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        along = (k / n).T @ w / n
        assert np.allclose(cov @ along, along * values[:most], rtol=1e-8, atol=1e-8 * values[0])


def test_whitening_of_a_table(spark):
    df = spark.read.parquet(f"{TINY}/embeddings.parquet")
    sound = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check_whitened(whitening.op11_whitening(spark, TINY).collect(), sound)


def test_whitening_of_bad_rows(spark):
    r = random.Random(2)
    good = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(20)] + [(3, [0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 1.0]), (53, [float("inf"), 0.0, 1.0]), (54, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], "vec_id long, embedding array<double>, n int, d int, at string")
    check_whitened(whitening.whitened_rows(df).collect(), good)
    assert whitening.whitened_rows(df.filter("vec_id >= 50")).collect() == [] == whitening.whitened_rows(df.limit(0)).collect()
    # Vectors that span less give fewer components; one vector gives none; lengths are apart; null ids stay.
    flat = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    other = [(None, [1.0, 5.0]), (None, [2.0, 1.0]), (102, [7.0, 3.0])]
    out = whitening.whitened_rows(spark.createDataFrame(flat + other + [(200, [4.0])], "vec_id long, embedding array<float>")).collect()
    check_whitened([x for x in out if x["vec_id"] is not None and x["vec_id"] < 100], flat)
    rest = [x for x in out if x["vec_id"] is None or x["vec_id"] >= 100]
    assert sorted((x["vec_id"] or -1, x["component"], x["n"]) for x in rest) == [(-1, 1, 3), (-1, 1, 3), (-1, 2, 3), (-1, 2, 3), (102, 1, 3), (102, 2, 3)]
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.5, 4.0])], "vec_id long, embedding array<double>")
    rows, _, errors = whitening.whiten(huge)
    assert rows.count() == 3 and errors[2] < 1e-4 and all(x["deviation"] > 2**63 for x in rows.collect() if x["vec_id"] < 3)


def test_parts_do_not_grow_with_rows(spark, monkeypatch):
    """Each task gives one row for each row of its matrix, and merging in groups changes nothing."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(5))).alias("embedding")).repartition(7)
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened_rows(df).collect()}
    monkeypatch.setattr(whitening, "MERGED", 2)
    two = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whitened_rows(df).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-9


# Spelling


def brute_variants(rows, least=6, support=5, ratio=5, thin=199):
    import re

    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= support}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(own), form[w], n[best] if form[w] else None)
    for w, o in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (*o, root)
    return out


def variants(df, **more):
    rows = spelling.spelling_variants(df, **more).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_variants_of_random_words(spark):
    """Few letters, so that bigrams repeat and edits fall on every place."""
    r = random.Random(11)
    words = ["".join(r.choice("aabÀ") for _ in range(r.randrange(4, 10))) for _ in range(300)]
    words += ["abababab", "babababa", "abababa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaabaaaa", "÷×ÿÀÁÂ", "÷×ÿÀÁ"]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)).upper() if i % 7 == 0 else "_".join(r.choice(words) for _ in range(40))) for i in range(120)]
    rows += [(None, "AbAbAb.ababab ababab-ababab9ababab"), (3, None), (4, ""), (4, "12 34"), (5, "naïve Naïve NAïVE " * 3)] * 2
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, text string, n long, word string")
    for more in ({}, {"least": 4, "support": 1, "ratio": 2, "thin": 3}):
        got = variants(df, **more)
        assert got == brute_variants(rows, **more) and sum(v[1] > 0 for v in got.values()) > 100
    assert variants(df.limit(0)) == {}


def test_chains_of_forms(spark):
    """Five forms in a row: each has five times as many as the one before."""
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(i, " ".join([w] * 5 ** (i + 1))) for i, w in enumerate(words)]
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"), thin=1 << 40)
    assert {v[4] for v in got.values()} == {"aabbbb"} and got["aaaaaa"][:4] == (5, 1, "aaaaab", 25)


def test_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 1000)
    long = "q" * 30_000
    rows = [(1, " ".join([long, long + "Z", "Shorter", "shortest"] * 6))]
    got = {(w[:9], len(w)): v[:2] for w, v in variants(spark.createDataFrame(rows, "doc_id long, text string")).items()}
    assert len(got) <= 4 and sum(v[1] for v in got.values()) in (2, 0) and sum(v[0] for v in got.values()) == 24


@pytest.mark.parametrize("seed", range(30))
def test_keys_meet(seed):
    """Any two words one edit apart share a key, under any order of bigrams."""
    r = random.Random(seed)
    rank = np.array(r.sample(range(1 << 16), 1 << 16), np.int32)
    for _ in range(300):
        a = bytes(r.choice(b"abc\xe0") for _ in range(r.randrange(4, 14)))
        at, kind = r.randrange(len(a)), r.randrange(2)
        b = a[:at] + r.choice([b"a", b"b", b"c", b"x"]) + a[at + kind :]
        if a == b:
            continue
        own, other = (spelling.link_keys(w, spelling.rarest(w, rank)) for w in (a, b))
        assert own[0] & (other[1] if kind == 0 else other[0]), (a, b)


# Shards


def least_capacity(sizes, shards):
    """The least largest sum of a contiguous partition, by trying all cuts."""
    best = [0, *np.cumsum(sizes).tolist()]
    total = best[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], total[j] - total[i]) for i in range(j + 1)) for j in range(len(total))]
    return best[-1]


def test_least_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 64), monkeypatch.setattr(sharding, "FIRST", 3)
    for seed in range(6):
        r = random.Random(seed)
        rows = sorted((r.randrange(1 << 60), r.choice([1, 7, r.randrange(1, 500)])) for _ in range((1, 4, 30, 90, 90, 150)[seed]))
        if seed % 2:
            rows[len(rows) // 2] = (rows[len(rows) // 2][0], sum(b for _, b in rows) // 2)
        capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "grp long, bytes long"), 5)
        loads = Counter()
        for h, b in rows:
            loads[sum(h >= c for c in cuts)] += b
        assert capacity == least_capacity([b for _, b in rows], 5) and max(loads.values()) <= capacity and len(cuts) == 4 and cuts == sorted(cuts)


def check_shards(out, rows, shards):
    """rows: (doc_id, text)."""
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    of, slots, loads = {}, defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert {(r["law"], r["grown_shard"]) for r in out} <= {("bytes", None)} and set(slots) <= set(range(shards))
    return loads


def test_shards_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    loads = check_shards(sharding.op13_sharding(spark, TINY).collect(), rows, 8)
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    assert len(loads) == 8 and max(loads.values()) < sum(loads.values()) / 8 + max(groups.values())
    again = [sorted(map(tuple, sharding.op13_sharding(spark, TINY).collect()), key=repr) for _ in range(2)]
    assert again[0] == again[1]


def test_shards_of_hot_and_bad_rows(spark, tmp_path):
    """A text that a third of all rows share, nulls, empty and long texts, repeated rows."""
    rows = [(i, "the same text") for i in range(300)] + [(i, f"{i} é" * (i % 5)) for i in range(300, 900)] + [(None, None)] * 40 + [(7, ""), (7, ""), (None, "x" * 5000)]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], "doc_id long, text string, shard int, size int, grp string")
    loads = check_shards(sharding.shard_documents(df).collect(), rows, 8)
    assert len(loads) == 8
    check_shards(sharding.shard_documents(df, 3).collect(), rows, 3)
    assert sharding.shard_documents(df.limit(0)).collect() == [] and len(check_shards(sharding.shard_documents(df.limit(1)).collect(), rows[:1], 8)) == 1
    sharding.write_shards(df.drop("shard"), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows) and {r["shard"]: r["b"] for r in back.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b")).collect()} == dict(loads)


def test_shards_use_no_python(spark):
    plan = sharding.op13_sharding(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Methods of earlier operators


@pytest.mark.parametrize("text", ["a" * 2_000_000 + " http://a@b.c", "7" * 2_000_000 + "://a:b@c", "aZ3+/" * 400_000 + " x://a:b@", "AKIA" * 500_000, "eyJabcdefgh." * 160_000, "-----BEGIN " * 180_000, "password" + " " * 2_000_000, "xoxa-" + "a" * 2_000_000 + "_"])
def test_secrets_in_very_long_runs(text):
    """Work grows with the text, not with its square."""
    import time

    from contourlake.llm import secrets

    began = time.time()
    secrets.find_secrets(text)
    assert time.time() - began < 10  # some 0.2 s to 0.8 s; a square would take an hour


def test_addresses_as_by_one_pattern():
    import re

    from contourlake.llm import secrets

    r, whole = random.Random(1), re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/?#:@]+:[^\s/?#@]+)@")
    for _ in range(20_000):
        text = "".join(r.choice(["a", "1", "://", ":", "@", "/", " ", "+", "é"]) for _ in range(r.randrange(4, 24)))
        assert [m.span(1) for m in whole.finditer(text)] == [m.span(1) for m in secrets._addresses(text)]


def test_cells_at_every_size(spark, monkeypatch):
    """k-means is fitted for any table, and vectors stand in more than one cell."""
    from contourlake.llm import vector_dedup

    fitted = []
    fit = vector_dedup.fit_cells
    monkeypatch.setattr(vector_dedup, "fit_cells", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    out = vector_dedup.op5_vector_dedup(spark, TINY)
    assert out.count() == spark.read.parquet(f"{TINY}/embeddings.parquet").count() and [len(c) >= 2 for c in fitted] == [True]
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(few).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)} and len(fitted[-1]) == 2
