"""Cosine search over stored unit vectors, and the building of such tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.nearest import k_best

#: Query vectors of a block; they go to every task.
MOST_QUERIES = 10_000
#: Scores that a task computes at a time.
PRODUCTS = 4_000_000
#: Pairs that a task gives at a time.
PAIRS = 250_000


def scores(embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, corpus_idx, score of every pair: a matrix product a batch, in parts of PAIRS, with blocks of MOST_QUERIES queries as in top().

    Pairs are as many as rows times queries. Rows and queries that are null, hold nulls or have another length than
    most are multiplied one by one, which gives null.
    """
    rows = embeddings.select(F.col("corpus_idx").cast("long").alias("corpus_idx"), "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
    known = asked.where(F.col("query").isNotNull()).groupBy(F.size("query").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = known["n"] if known else 0
    whole = lambda c: F.coalesce((F.size(c) == n) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
    dot = F.aggregate(F.zip_with(F.col("embedding"), F.col("query"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    one = lambda a, b: a.crossJoin(b).select("query_id", "corpus_idx", F.round(dot, 6).alias("score"))
    out = one(rows.where(~whole("embedding")), asked).unionByName(one(rows.where(whole("embedding")), asked.where(~whole("query"))))
    good = asked.where(whole("query"))
    found = good.limit(MOST_QUERIES + 1).collect()
    more = iter(found) if len(found) <= MOST_QUERIES else good.toLocalIterator()
    for block in iter(lambda: list(islice(more, MOST_QUERIES)), []):
        out = out.unionByName(_pairs(rows.where(whole("embedding")), block))
    return out


def _pairs(vectors: DataFrame, rows: list) -> DataFrame:
    """query_id, corpus_idx, score of every row and every query of a block."""
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["query"] for r in rows], np.float64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            numbers = batch.column("corpus_idx").to_numpy()
            step = max(1, PAIRS // batch.num_rows)
            for a in range(0, len(ids), step):
                some = ids[a : a + step]
                score = np.round(matrix[a : a + step] @ x.T, 6).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(numbers))), pa.array(np.tile(numbers, len(some))), pa.array(score)], names=["query_id", "corpus_idx", "score"])

    return vectors.mapInArrow(products, "query_id long, corpus_idx long, score double")


def top(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k most similar rows of each query: a matrix product a batch, a top-k a task, then one over tasks.

    queries(query_id, query) come to the driver in blocks of MOST_QUERIES; each block goes over all rows, with tasks of
    its own. For large sets of queries, or rows that are asked again and again, nearest.build and nearest.top do the
    same without the driver, and skip what cannot matter.
    """
    vectors = embeddings.where(F.col("embedding").isNotNull()).select("corpus_idx", "embedding")
    queries = queries.select("query_id", "query")
    rows = queries.limit(MOST_QUERIES + 1).collect()
    more = iter(rows) if len(rows) <= MOST_QUERIES else queries.toLocalIterator()
    parts = [_part(vectors, block, k) for block in iter(lambda: list(islice(more, MOST_QUERIES)), [])]
    part = reduce(DataFrame.unionByName, parts or [_part(vectors, [], k)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_idx"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def _part(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    """query_id, corpus_idx, score of each task's k most similar rows of every query of a block."""
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["query"] for r in rows], np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            numbers, n = batch.column("corpus_idx").to_numpy(), min(k, batch.num_rows)
            step = max(1, PRODUCTS // batch.num_rows)
            for a in range(0, len(ids), step):  # so many queries that their scores fit
                scores = np.round(matrix[a : a + step] @ x.T, 6)
                kth = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
                row, col = np.nonzero(scores >= kth[:, None])
                held = tuple(np.concatenate([h, f]) for h, f in zip(held, (ids[a : a + step][row], numbers[col], scores[row, col]), strict=True))
            some = k_best(*held, k)
            held = tuple(h[some] for h in held)
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["query_id", "corpus_idx", "score"])

    return vectors.select(F.col("corpus_idx").cast("long").alias("corpus_idx"), "embedding").mapInArrow(best, "query_id long, corpus_idx long, score double")


def with_content(embeddings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Vectors of rows whose narrator and text are not blank."""
    narrator = F.coalesce("narrator", F.lit("")) if "narrator" in corpus.columns else F.lit("")
    filled = corpus.where(T.stripped(F.concat(narrator, F.coalesce("text", F.lit("")))) != "")
    return embeddings.join(filled.select("corpus_idx"), "corpus_idx", "left_semi")


def oversampled(ranked: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    """A pool by similarity, sorted anew by tier, grade and similarity, and cut. ranked: top() with pool_size(limit)."""
    rows = ranked.drop("rank").join(corpus.select("corpus_idx", "collection", "tier", "grade_tier"), "corpus_idx")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "grade_tier", F.desc("score"), "corpus_idx"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def pool_size(limit: int) -> int:
    return max(20 * limit, 200)


Encoder = Callable[[list[str]], np.ndarray]


def build(corpus: DataFrame, encoder: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """corpus_idx and unit vectors of narrator and text. encoder() is called once a task and gives the function."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for rows in batches:
            found = [model(rows["text"].iloc[i : i + batch].tolist()) for i in range(0, len(rows), batch)]
            vectors = np.vstack(found).astype(np.float64) if found else np.zeros((0, 1))
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = (vectors / np.where(norms == 0, 1, norms)).astype(np.float32)
            yield pd.DataFrame({"corpus_idx": rows["corpus_idx"], "embedding": list(unit)})

    text = T.embedding_text(F.coalesce("narrator", F.lit("")) if "narrator" in corpus.columns else F.lit(""), F.coalesce("text", F.lit("")))
    return corpus.select("corpus_idx", text.alias("text")).mapInPandas(encode, "corpus_idx long, embedding array<float>")
