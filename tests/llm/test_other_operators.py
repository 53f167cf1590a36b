"""Chat formatting, vectors, components, the SQL of the queries and the pipeline."""

import glob
import hashlib
import os
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contourlake.llm import ann, chat_format, graph, ngram_join, registry, secrets, vector_dedup

TINY = "/root/testdata/sf0.001"


# SQL


def plain(v):
    return None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, TINY).toPandas()
    c = duckdb.connect()
    for path in glob.glob(f"{TINY}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = c.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[sorted(want.columns)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want)


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 14))


# Chats


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s> [INST] \\ <\\s> [\\INST] \\\\"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "user", "[SEP][/INST]<s>"),
    (2, 5, None, "a\nb"), (2, None, "assistant", "first: null turn"), (2, 5, None, "a\nb"), (3, 0, "we[INST]ird</s>", "x" * 20_000), (None, 1, "assistant", "no id 😀"), (4, 0, "assistant", "<"), (4, 1, "user", "/s>"),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*c, "clash", 1) for c in CHATS], "conv_id long, turn long, role string, text string, formatted string, t int")
    out = {r["conv_id"]: r for r in chat_format.format_chats(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("cut", chat_format.spans_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in CHATS:
        own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(out) == set(own)
    for conv, turns in own.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        r = out[conv]
        assert [tuple(t) for t in r["turns"]] == turns
        masked = [r["formatted"][a:b] for a, b in r["loss_spans"]]
        assert masked == r["cut"] and [re.sub(r"(?s)\\(.)", r"\1", x) for x in masked] == [text for role, text in turns if role == "assistant"]
        blocks = sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))
        assert len(r["blocks"]) == blocks == r["formatted"].count("</s>")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """Work does not grow with the square of the number of turns."""
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), (-F.col("id")).alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit("</s>")).alias("text"))
    out = chat_format.format_chats(df)
    cut = chat_format.spans_text(F.col("formatted"), F.col("loss_spans"))
    back = chat_format.read_back(F.col("formatted"))
    began = time.time()
    r = out.select("formatted", "loss_spans", F.size(back).alias("n"), F.get(back, F.lit(0)).alias("first"), cut.alias("cut")).first()
    took = time.time() - began
    assert r["n"] == 20_000 and tuple(r["first"]) == ("user", "19999</s>")
    assert r["cut"] == [f"{i}<\\/s>" for i in range(19_999, -1, -1) if i % 3 == 0]
    assert r["cut"] == [r["formatted"][a:b] for a, b in r["loss_spans"]]
    assert took < 5, took


# Components


def brute_components(nodes, links):
    own = {v: v for v in nodes}

    def find(v):
        while own[v] != v:
            v = own[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        own[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(i, i + 1) for i in range(0, 120)] + rng.integers(200, 400, (150, 2)).tolist() + [(500, int(x)) for x in rng.integers(501, 900, 200)] + [(7, 7)]
    df = spark.createDataFrame([tuple(map(int, x)) for x in links] + [(None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == brute_components({v for x in real for v in x}, real)
    assert graph.connected_components(df.limit(0)).count() == 0


# Vectors


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [v.tolist() for v in base]
    for _ in range(80):
        rows.append((base[rng.integers(5)] + rng.normal(size=16) * 0.05).tolist())
    rows += [rows[0]] * 5 + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    return [(i, v, "x", 1) for i, v in enumerate(rows)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    data = vectors()
    df = spark.createDataFrame([*data, (None, data[0][1], "x", 1), (3, data[3][1], "x", 1)], "vec_id long, embedding array<double>, component_id string, n long")
    got = vector_dedup.near_duplicates(df).collect()
    assert len(got) == len(data) + 2
    assert Counter(r["vec_id"] for r in got)[3] == 2
    rows = [(i, np.array(v, float)) for i, v, *_ in data if usable(v)] + [(3, np.array(data[3][1], float))]
    links = defaultdict(int)
    pairs = []
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows):
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                pairs.append((i, j))
    want = brute_components([i for i, *_ in data], pairs)
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None
        else:
            assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["component_id"] == r["vec_id"])
            assert r["n_links"] == links[r["vec_id"]] // (2 if r["vec_id"] == 3 else 1)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
    assert {r["n_links"] for r in vector_dedup.near_duplicates(df.filter("embedding IS NULL")).collect()} == {0}


def two_lengths():
    """Vectors of two models, a third of them of another length, near pairs among both."""
    rng = np.random.default_rng(6)
    rows = []
    for d, n in ((16, 100), (12, 50)):
        base = rng.normal(size=(n // 2, d))
        rows += [v.tolist() for v in base] + [(v + rng.normal(size=d) * 0.05).tolist() for v in base]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [8, 64, 2048])
def test_near_duplicates_of_each_length(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    data = two_lengths()
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    rows = [(i, np.array(v) / np.linalg.norm(v)) for i, v in data]
    want = {i: sum(len(x) == len(y) and x @ y >= 0.9 for j, y in rows if j != i) for i, x in rows}
    assert got == want and all(want.values())


@pytest.mark.parametrize("window", [1.0, 0.5])
def test_neighbours_of_each_length(spark, monkeypatch, window):
    monkeypatch.setattr(ann, "CHUNK", 16)
    data = two_lengths() + [(900, [1.0, 0.0]), (901, [0.5, 0.5])]
    got = defaultdict(list)
    for r in ann.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, k=3, window=window).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    rows = {i: np.array(v) for i, v in data}
    for q, x in rows.items():
        if q % 10 == 0:
            assert got[q] == [i for _, i in sorted((((x - y) ** 2).sum(), i) for i, y in rows.items() if i != q and len(x) == len(y))[:3]]


@pytest.mark.parametrize("cells,threshold", [(60, 0.9), (7, 0.9), (25, 0.6)])
def test_no_link_is_lost_at_a_border(spark, monkeypatch, cells, threshold):
    """Unstructured vectors and pairs right at the threshold, in cells of arbitrary centres and tiny blocks: equal to all pairs."""
    rng = np.random.default_rng(cells)
    x = rng.normal(size=(700, 12))
    for i in range(350, 700):
        # At an angle of just about the threshold to another vector.
        u = x[i - 350] / np.linalg.norm(x[i - 350])
        side = x[i] - (x[i] @ u) * u
        angle = np.arccos(threshold) * rng.uniform(0.7, 1.1)
        x[i] = (np.cos(angle) * u + np.sin(angle) * side / np.linalg.norm(side)) * rng.uniform(0.1, 9)
    x[:40] = x[0] + 0.05 * rng.normal(size=(40, 12))
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "fit_cells", lambda sample, n, t: (lambda c: c / np.linalg.norm(c, axis=1, keepdims=True))(rng.normal(size=(cells, 12))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df, threshold=threshold).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    pairs = np.argwhere(linked).tolist()
    part = brute_components(range(len(x)), pairs)
    assert got == {i: (int(linked[i].sum()), part[i]) for i in range(len(x))}


def test_cells_fit_the_vectors():
    """Few cells for vectors without structure, many for well-parted groups."""
    rng = np.random.default_rng(1)
    loose = rng.normal(size=(4000, 64))
    centres = rng.normal(size=(400, 64))
    tight = centres[rng.integers(0, 400, 4000)] + 0.05 * rng.normal(size=(4000, 64))
    few, many = (len(vector_dedup.fit_cells(v, 50_000, 0.9)) for v in (loose, tight))
    assert few < many


def test_hilbert_neighbours_are_adjacent():
    for bits, m in ((3, 2), (2, 3), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), axis=-1).reshape(-1, m)
        key = ann.hilbert_index(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    monkeypatch.setattr(ann, "QUERIES_A_TASK", 4)
    data = vectors()
    df = spark.createDataFrame([*data, (None, data[0][1], "x", 1), (3, data[3][1], "x", 1)], "vec_id long, embedding array<double>, rank string, score int")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id") % 5 == 0, window=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = {i: np.array(v, float) for i, v, *_ in data if usable(v) and len(v) == 16}
    assert set(got) == {i for i in rows if i % 5 == 0}
    for q, found in got.items():
        exact = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), i) for i, x in rows.items() if i != q)[:10]
        assert [(i, pytest.approx(s)) for _, i, s in found] == [(i, s) for s, i in exact]
        assert [r for r, *_ in found] == list(range(1, 11))
    few = df.filter("vec_id IN (0, 1, 2)")
    assert len(ann.nearest_neighbours(few, F.col("id") == 0).collect()) == 2
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df, F.lit(False)).count() == 0


def test_nearest_among_copies(spark):
    """A vector that most rows share: the smallest ids are found, whatever the window."""
    x = np.random.default_rng(4).normal(size=(30, 8))
    rows = [(i, x[0].tolist()) for i in range(100, 700)] + [(i, x[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    copies = [0, *range(100, 111)]
    assert set(got) == {0, *range(100, 700, 50)}
    for q, found in got.items():
        assert found == [(i, 0.0) for i in copies if i != q][:10]


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = df["vec_id"].to_numpy(), np.array(df["embedding"].tolist(), float)
    found = defaultdict(set)
    for r in ann.op8_ann(spark, sf).collect():
        found[r["query_id"]].add(r["vec_id"])
    right = 0
    for q in found:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        right += len(found[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(found) == (ids % 100 == 0).sum() and right / (10 * len(found)) >= 0.9


# Pipeline


def test_pipeline_stages(spark, documents):
    columns = corpus_pipeline.COLUMNS
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "test")
        kept[name] = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
    ids = lambda name: sorted(r["doc_id"] for r in kept[name] if r["doc_id"] is not None)
    assert not set(ids("language")) & {6, 7, 8, 10}
    # One of each group; a row that repeats another goes, one without an id stays.
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(documents).collect()}
    assert ids("near_duplicates") == sorted(i for i in set(ids("language")) if groups[i] == i)
    assert [r["doc_id"] for r in kept["near_duplicates"]].count(None) == 1
    texts = {r["doc_id"]: r for r in kept["secrets"]}
    assert ids("secrets") == ids("near_duplicates") and texts[13]["text"].startswith("[SECRET]")
    assert all(not secrets.find_secrets(r["text"]) for r in kept["secrets"]) and all(r["n_chars"] == len(r["text"]) for r in kept["secrets"])
    times = Counter(r["doc_id"] for r in kept["mixture"])
    assert set(times) <= set(texts) and max(times.values()) <= 2
    assert Counter(r["doc_id"] for r in kept["pieces"]) == times
    for r in kept["pieces"]:
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()


def test_pipeline_of_nothing(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "test")
        assert docs.count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, TINY)
    docs = spark.read.parquet(f"{TINY}/documents.parquet").count()
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and 0 < out.select("doc_id").distinct().count() <= docs
