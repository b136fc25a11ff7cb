"""Merging legs: union with min-max norms, reciprocal rank fusion, strong and weak rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.fixed import FIRST_FACETS, MODE_WEIGHTS
from quern.operators.sizes import settled

LEGS = ("bm25", "semantic", "term")
RRF_K = 60


def mode_weights(mode: str) -> tuple[float, float, float]:
    if mode not in MODE_WEIGHTS:
        raise ValueError(f"unknown mode {mode!r}; choices: {sorted(MODE_WEIGHTS)}")
    return MODE_WEIGHTS[mode]


def _leg(rows: DataFrame | None, number: int, keys: list[str]) -> DataFrame | None:
    if rows is None:
        return None
    words = F.col("matched_words") if "matched_words" in rows.columns else F.array().cast("array<string>")
    over = Window.partitionBy(*keys)
    low, high = F.min("score").over(over), F.max("score").over(over)
    norm = F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low))
    return rows.select(*keys, "corpus_idx", F.lit(number).alias("leg"), "rank", "score", norm.alias("norm"), words.alias("words"))


def union(bm25: DataFrame | None, semantic: DataFrame | None, term: DataFrame | None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row a query and text that any leg found.

    Legs are (keys, corpus_idx, score, rank[, matched_words]); a missing one is None and
    counts as empty. Norms are min-max within a leg, 1 where all its scores agree. The
    place is the order of first finding: keyword rows, then new dense, then new term rows.
    """
    keys = list(keys)
    legs = [x for x in (_leg(rows, i, keys) for i, rows in enumerate((bm25, semantic, term))) if x is not None]
    rows = legs[0]
    for more in legs[1:]:
        rows = rows.unionByName(more)
    only = lambda i, c: F.coalesce(F.max(F.when(F.col("leg") == i, F.col(c))), F.lit(0.0))
    merged = rows.groupBy(*keys, "corpus_idx").agg(
        F.array_sort(F.collect_set(F.element_at(F.array(*(F.lit(x) for x in LEGS)), F.col("leg") + 1))).alias("sources"),
        *(only(i, "score").alias(name) for i, name in enumerate(LEGS)), *(only(i, "norm").alias(f"{name}_norm") for i, name in enumerate(LEGS)),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("matched_words"), F.min(F.struct("leg", "rank")).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first.leg", "first.rank", "corpus_idx"))
    return merged.withColumn("place", place).drop("first")


def reciprocal_rank(variants: DataFrame, k: int = RRF_K) -> DataFrame:
    """Pools of a query's variants merged: the sum of 1 / (k + place), the greatest scores and norms, all sources and words."""
    most = [F.max(c).alias(c) for c in (*LEGS, *(f"{x}_norm" for x in LEGS))]
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("sources", "matched_words")]
    merged = variants.groupBy("query_id", "corpus_idx").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("rrf"), *most, *sets, F.min(F.struct("variant_id", "place")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first.variant_id", "first.place"))
    return merged.withColumn("place", place).drop("first")


def weighted(pool: DataFrame, mode: str) -> DataFrame:
    """The pool with score: the mode's weighted sum of norms."""
    a, b, c = mode_weights(mode)
    return pool.withColumn("score", F.round(F.col("bm25_norm") * a + F.col("semantic_norm") * b + F.col("term_norm") * c, 6))


def weighted_by_mode(pool: DataFrame, modes: DataFrame) -> DataFrame:
    """The pool with score: the weighted sum of norms by each query's own mode, of modes (query_id, mode)."""
    of = modes.select("query_id", *(F.coalesce(*(F.when(F.col("mode") == m, F.lit(w[i])) for m, w in MODE_WEIGHTS.items())).alias(f"w{i}") for i in range(3)))
    score = F.round(F.col("bm25_norm") * F.col("w0") + F.col("semantic_norm") * F.col("w1") + F.col("term_norm") * F.col("w2"), 6)
    return pool.join(of, "query_id").withColumn("score", score).drop("w0", "w1", "w2")


def split(scored: DataFrame, limit: int, threshold: float | None = None) -> DataFrame:
    """The pool with rank and bucket: the first `limit` rows at or over the threshold are strong, all others weak."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place"))
    over = F.lit(True) if threshold is None else F.col("score") >= threshold
    return scored.withColumn("rank", rank).withColumn("bucket", F.when(over & (F.col("rank") <= limit), "strong").otherwise("weak"))


def hydrate(rows: DataFrame, corpus: DataFrame, queries: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Ranked rows as they are shown; similarity and matched_words are null where their leg found nothing."""
    text = corpus.select("corpus_idx", "collection", "id_in_book", "number", "grade", "text")
    out = text.join(settled(rows), "corpus_idx").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    title = F.col("collection")
    if titles is not None:
        out = out.join(settled(titles.select(F.col("slug").alias("collection"), "english_title")), "collection", "left")
        title = F.coalesce("english_title", "collection")
    return out.select(
        "query_id", "bucket", "rank", "corpus_idx", "collection", title.alias("title"), "id_in_book", "number", "grade", T.snippet(F.col("text"), F.col("query")).alias("snippet"), "score", "sources",
        F.when(F.size("matched_words") > 0, F.col("matched_words")).alias("matched_words"), F.when(F.array_contains("sources", "semantic"), F.col("semantic")).alias("similarity"),
    )


def chip_words(rows: DataFrame) -> DataFrame:
    """query_id, word, n over the strong rows of a query, or over its weak rows if none is strong."""
    strong = rows.groupBy("query_id").agg(F.max((F.col("bucket") == "strong").cast("int")).alias("any"))
    used = rows.join(strong, "query_id").where((F.col("bucket") == "strong") | (F.col("any") == 0))
    return used.select("query_id", F.explode("matched_words").alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))


def facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("n"))


def facet_order(collections: DataFrame) -> DataFrame:
    """Collections (slug, english_title) with their position in filters: the canonical ones first, the others by title."""
    first = F.array_position(F.array(*(F.lit(s) for s in FIRST_FACETS)), F.col("slug"))
    position = F.row_number().over(Window.orderBy(F.when(first > 0, first).otherwise(len(FIRST_FACETS) + 1), "english_title", "slug"))  # a row a collection
    return collections.withColumn("position", position)


def merged_order(rows: DataFrame) -> DataFrame:
    """Rows of several searches by score, or by similarity where the score is null or 0."""
    key = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.nullif(F.col("similarity"), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc(key), "corpus_idx")))


def filtered(rows: DataFrame, collections: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """Rows of the collections that hold any of the words; an empty choice lets everything pass."""
    if collections:
        rows = rows.where(F.col("collection").isin(collections))
    if words:
        rows = rows.where(F.arrays_overlap("matched_words", F.array(*(F.lit(w) for w in words))))
    return rows


def page(rows: DataFrame, number: int, size: int = 10, weak: bool = False) -> DataFrame:
    """One page of each query's rows, strong before weak."""
    shown = rows if weak else rows.where("bucket = 'strong'")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("bucket", "rank"))
    return shown.withColumn("at", at).where((F.col("at") > (number - 1) * size) & (F.col("at") <= number * size))
