"""Keyword and dense top-k that skip: the rows of the full computation, few postings read, hot terms and cells split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import blockmax, bm25, dense, nearest


def plain_rows(df):
    return sorted((r["query_id"], r["rank"], r["corpus_idx"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Texts where `the` stands in all rows, `mid` in a third, `rare` in few, written as an index with its blocks."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        words = ["the"] * rng.randrange(1, 4) + ["mid"] * (i % 3 == 0) + ["rare"] * (3 if i in (17, 4100) else int(i % 997 == 0))
        rows.append((i, " ".join(words + rng.choices([f"w{j}" for j in range(200)], k=rng.randrange(3, 60)))))
    rows += [(6000 + i, t) for i, t in enumerate(["", None, "the the the", "zz"])]
    path = str(tmp_path_factory.mktemp("index"))
    index = bm25.build(spark.createDataFrame(rows, "corpus_idx long, text string"))
    index.write(path)
    blockmax.build(bm25.Index.read(spark, path)).write(path)
    return path


QUESTIONS = [(0, "the rare"), (1, "mid w3"), (2, "the"), (3, "unknown words"), (4, ""), (5, "rare rare w7 w8 w9"), (6, "zz")]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_blockmax_gives_the_rows_of_all_postings(spark, written, k):
    queries = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    index, blocks = bm25.Index.read(spark, written), blockmax.Blocks.read(spark, written)
    assert plain_rows(blockmax.top(blocks, queries, k)) == plain_rows(bm25.top(bm25.scores(index, queries), k))


def test_blockmax_with_more_terms_and_ranges_than_literals(spark, written, monkeypatch):
    queries = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    index, blocks = bm25.Index.read(spark, written), blockmax.Blocks.read(spark, written)
    monkeypatch.setattr(bm25, "MOST_LITERALS", 2)
    monkeypatch.setattr(blockmax, "MOST_RANGES", 1)
    assert plain_rows(blockmax.top(blocks, queries, 5)) == plain_rows(bm25.top(bm25.scores(index, queries), 5))


def test_negative_weights_keep_the_bound(spark):
    """Terms of most rows weigh less than nothing where the mean idf does; the rows are the same."""
    rows = [(i, "aa bb" if i % 9 else "aa bb cc") for i in range(300)] + [(300, "cc cc aa")]
    index = bm25.build(spark.createDataFrame(rows, "corpus_idx long, text string"))
    queries = spark.createDataFrame([(0, "aa cc"), (1, "aa bb")], "query_id long, text string")
    assert plain_rows(blockmax.top(blockmax.build(index), queries, 5)) == plain_rows(bm25.top(bm25.scores(index, queries), 5))


def test_blockmax_reads_a_small_share(spark, written, monkeypatch):
    """Rows 17 and 4100 answer; `the` stands in all rows, yet only the two ranges that can hold an answer are read."""
    queries = spark.createDataFrame([(0, "the rare")], "query_id long, text string")
    found = blockmax.reading(blockmax.Blocks.read(spark, written), queries, 2).first()
    assert found["postings"] > 6000 and found["read"] <= 0.5 * found["postings"]


def test_a_frequent_term_is_many_blocks_and_files(spark, written):
    blocks = blockmax.Blocks.read(spark, written)
    assert blocks.bodies.where("term = 'the'").count() == 6
    assert blocks.bodies.agg(F.max(F.size("ids"))).first()[0] <= blockmax.WIDTH
    files = spark.read.parquet(f"{written}/postings").where("term = 'the'").select(F.input_file_name()).distinct().count()
    assert spark.read.parquet(f"{written}/postings").select(F.input_file_name()).distinct().count() >= files >= 1


def clustered(n=3000, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, dims)) * 3
    x = middle[rng.integers(0, 12, n)] + 0.2 * rng.standard_normal((n, dims))
    x[: n // 3] = x[0]  # a third of all rows are one vector
    return np.float32(x / np.linalg.norm(x, axis=1)[:, None])


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered())] + [(99_999, None)], "corpus_idx long, embedding array<float>")


def asked(vectors, step=20):
    return vectors.where(F.col("corpus_idx") % step == 0).where("embedding is not null").select(F.col("corpus_idx").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))


@pytest.mark.parametrize("bounds", [{}, {"pack": 50, "cells": 12}, {"pack": 7, "cells": 1}])
def test_nearest_is_the_full_product(spark, vectors, bounds, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "UNIT", 3)
    monkeypatch.setattr(nearest, "GROUP", 40)
    nearest.build(vectors, **bounds).write(str(tmp_path))
    index = nearest.Index.read(spark, str(tmp_path))
    assert index.packs.agg(F.sum("n")).first()[0] == 3000
    assert plain_rows(nearest.top(index, asked(vectors), 15)) == plain_rows(dense.top(vectors, asked(vectors), 15))


def test_nearest_for_vectors_of_any_length_and_more_rows_than_there_are(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * 10 ** rng.uniform(-2, 2)).tolist()) for i in range(80)] + [(500, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "corpus_idx long, embedding array<float>")
    queries = spark.createDataFrame([(0, rng.standard_normal(5).tolist()), (1, [0.0] * 5), (2, None)], "query_id long, query array<double>")
    index = nearest.build(frame, pack=4)
    for k in (3, 200):
        assert plain_rows(nearest.top(index, queries, k)) == plain_rows(dense.top(frame, queries.where("query is not null"), k))
    none = nearest.build(frame.where("corpus_idx < 0"))
    assert nearest.top(none, queries, 3).collect() == []


def test_cells_and_packs_are_skipped(vectors):
    """Bounds leave most cells of clustered vectors out: the work is counted as packs that a query's threshold does not rule out."""
    index = nearest.build(vectors, pack=100, cells=12)
    packs = [r.asDict() for r in index.packs.collect()]
    centers = {r["cell"]: np.array(r["center"]) for r in index.cells.collect()}
    x = clustered().astype(np.float64)
    q = x[2000]
    least = np.sort(x @ q)[-10]
    read = 0
    for p in packs:
        away = np.linalg.norm(q - centers[p["cell"]])
        gap = max(away - p["high"], p["low"] - away, 0)
        inside = np.frombuffer(p["ids"], "<i8")
        bound = (q @ q + p["norm"] ** 2 - gap * gap) / 2
        assert (x[inside] @ q).max() <= bound + 1e-6
        read += p["n"] * (bound >= least)
    assert read <= 0.4 * len(x)


def test_batches_of_queries_in_blocks(spark, vectors, monkeypatch):
    want = plain_rows(dense.top(vectors, asked(vectors, 100), 4))
    monkeypatch.setattr(dense, "MOST_QUERIES", 7)
    assert plain_rows(dense.top(vectors, asked(vectors, 100), 4)) == want
