"""Rerankers as plug-ins: a scorer over (query, text) pairs, with a fallback to weights."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import fusion
from quern.operators.sizes import settled
from quern.sources.kept import kept

Scorer = Callable[[str, list[str]], list[float]]
FALLS_BACK = ("RuntimeError", "OSError", "ValueError", "AttributeError")
BATCH = 8


@dataclass
class Reranker:
    """name, a factory that is called once a task and gives the scorer, and the strong rows' least score.

    With a window the scorer judges a query's texts against each other, so many at a time, and windows overlap by
    half unless step says otherwise; without one it scores pairs, in batches of texts of like length.
    """

    name: str
    factory: Callable[[], Scorer]
    threshold: float = 0.5
    batch: int = BATCH
    window: int | None = None
    step: int | None = None


_REGISTRY: dict[str, Reranker] = {}


def register(reranker: Reranker) -> None:
    _REGISTRY[reranker.name] = reranker


def configured() -> Reranker | None:
    """The reranker that RERANKER_NAME names, with RERANKER_THRESHOLD and RERANKER_BATCH_SIZE; None if RERANKER_DISABLED is set or nothing is named."""
    name = os.environ.get("RERANKER_NAME")
    if not name or os.environ.get("RERANKER_DISABLED", "") not in ("", "0"):
        return None
    if name not in _REGISTRY:
        raise ValueError(f"unknown reranker {name!r}; choices: {sorted(_REGISTRY)}")
    own = _REGISTRY[name]
    return Reranker(name, own.factory, float(os.environ.get("RERANKER_THRESHOLD", own.threshold)), int(os.environ.get("RERANKER_BATCH_SIZE", own.batch)), own.window, own.step)


def pointwise(score: Callable[[str, str], float]) -> Scorer:
    """A scorer of a function that scores one pair at a time."""
    return lambda query, docs: [float(score(query, d)) for d in docs]


def listwise(order: Callable[[str, list[str]], list[tuple[int, float]]]) -> Scorer:
    """A scorer of a function that gives (place in docs, score) in any order; every text must be among them."""

    def scores(query: str, docs: list[str]) -> list[float]:
        found = dict(order(query, docs))
        if set(found) != set(range(len(docs))):
            raise ValueError(f"{len(found)} scores for {len(docs)} texts")
        return [float(found[i]) for i in range(len(docs))]

    return scores


def document_text(corpus: DataFrame):
    """Title, narrator, text and unmarked Arabic, a line each."""
    arabic = T.without_markup(F.col("arabic")) if "arabic" in corpus.columns else F.lit("")
    narrator = F.coalesce("narrator", F.lit("")) if "narrator" in corpus.columns else F.lit("")
    title = F.coalesce("title", F.col("collection")) if "title" in corpus.columns else F.col("collection")
    return F.concat_ws("\n", title, narrator, F.col("text"), arabic)


def model_scores(pool: DataFrame, corpus: DataFrame, queries: DataFrame, reranker: Reranker) -> DataFrame:
    """The pool with the model's score. Pairs are scored where they lie; a list is brought together a query, in windows."""
    pairs = corpus.select("corpus_idx", document_text(corpus).alias("doc")).join(settled(pool.select("query_id", "corpus_idx", "place")), "corpus_idx").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    factory, size = reranker.factory, reranker.batch
    if reranker.window:
        lists = pairs.select("query_id", "corpus_idx", "place", "query", "doc").repartition("query_id").sortWithinPartitions("query_id", F.desc("place"))
        ordered = lists.mapInArrow(_in_windows(factory, reranker.window, reranker.step), "query_id long, corpus_idx long, score double, place int")
        return pool.drop("place").join(ordered, ["query_id", "corpus_idx"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for rows in batches:
            out = pd.Series(0.0, index=rows.index)
            for _, group in rows.groupby("query_id"):
                order = group["doc"].str.len().sort_values(kind="stable").index
                for i in range(0, len(order), size):
                    part = order[i : i + size]
                    out[part] = scorer(group["query"].iloc[0], group.loc[part, "doc"].tolist())
            yield pd.DataFrame({"query_id": rows["query_id"], "corpus_idx": rows["corpus_idx"], "score": out.astype(float)})

    scored = pairs.select("query_id", "corpus_idx", "query", "doc").mapInPandas(score, "query_id long, corpus_idx long, score double")
    return pool.join(scored, ["query_id", "corpus_idx"])


def _in_windows(factory: Callable[[], Scorer], window: int, step: int | None):
    """Rows sorted by query and, last place first, as (query_id, corpus_idx, score, place) in the windows' order.

    A window slides from the end of a list to its start: what it likes best goes on into the next, the rest is put in
    place below. So one pass needs a window of texts at a time, and a text can climb from the last place to the first.
    A score is that of the last window a text was in, raised to that of the texts below it, so scores and places agree.
    """
    step = max(1, step or window // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        query, asked, held, placed = None, None, [], []  # texts in the window, and (corpus_idx, score) below it, the last first

        def slide(keep: int) -> None:
            scores = scorer(asked, [doc for _, doc in held])
            if len(scores) != len(held):
                raise ValueError(f"{len(scores)} scores for {len(held)} texts")
            order = sorted(range(len(held)), key=lambda i: (-scores[i], -i))  # last place first, so of equals the later one was ahead
            for i in reversed(order[keep:]):
                placed.append((held[i][0], float(scores[i])))
            held[:] = [held[i] for i in sorted(order[:keep])]

        def done() -> pa.RecordBatch:
            slide(0)
            scores = list(accumulate((s for _, s in placed), max))
            n = len(placed)
            columns = [pa.array([query] * n, pa.int64()), pa.array([c for c, _ in placed], pa.int64()), pa.array(scores, pa.float64()), pa.array(range(n, 0, -1), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "corpus_idx", "score", "place"])

        for batch in batches:
            for q, c, text, doc in zip(*(batch.column(n).to_pylist() for n in ("query_id", "corpus_idx", "query", "doc")), strict=True):
                if q != query and query is not None:
                    yield done()
                    held, placed = [], []
                query, asked = q, text
                if len(held) == window:
                    slide(max(window - step, 0))
                held.append((c, doc))
        if query is not None:
            yield done()

    return run


def scored_pool(pool: DataFrame, corpus: DataFrame, queries: DataFrame, mode: str, reranker: Reranker | None) -> tuple[DataFrame, str, str, float | None]:
    """The scored pool, the reranker's name, its status, and the threshold in force.

    Plans are lazy, so a model is run here, once; of the failures that fall back the
    class is read from the worker's traceback. Anything else is raised.
    """
    fusion.mode_weights(mode)
    if reranker is None:
        return fusion.weighted(pool, mode), "none", "disabled", None
    try:
        scored = kept(model_scores(pool, corpus, queries, reranker), "reranked")
        return scored, reranker.name, "ok", reranker.threshold
    except PythonException as e:
        found = re.findall(r"^(\w+)(?::|$)", str(e), re.MULTILINE)
        cls = next((c for c in reversed(found) if c in FALLS_BACK), None)
        if cls is None:
            raise
        return fusion.weighted(pool, mode), "none", f"fell_back: {cls}", None
