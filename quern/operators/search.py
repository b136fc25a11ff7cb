"""The query functions: one plan a call, for one query or many."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import bm25, dense, fusion, rerank, route, term
from quern.operators.corpus import SearchError
from quern.operators.sizes import settled

LEAST_LIMIT, MOST_LIMIT = 1, 50_000


@dataclass
class Response:
    """rows with their place, and a summary of one row a query, also for queries that find nothing."""

    rows: DataFrame
    summary: DataFrame


def word_list(counted: DataFrame) -> DataFrame:
    """query_id and matched_words: (word, count), the most frequent first, of rows (query_id, word, n)."""
    by = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))
    return counted.groupBy("query_id").agg(F.transform(by, lambda w: F.struct(w["word"].alias("word"), (-w["less"]).alias("count"))).alias("matched_words"))


def summary(queries: DataFrame, rows: DataFrame, words: DataFrame | None, limit: int, collections: list[str] | None = None, logic: DataFrame | None = None, total: str | None = None) -> DataFrame:
    """What a response says beside its rows: query, collections, total, limit, matched_words and match_logic where they apply.

    total names a column of rows that has the number of all matches; without it rows are all of them.
    """
    sizes = rows.groupBy("query_id").agg((F.max(total) if total else F.count(F.lit(1))).alias("total"))
    scope = F.array(*(F.lit(c) for c in collections)) if collections else F.lit(None).cast("array<string>")
    out = queries.select("query_id", F.col("text").alias("query"), scope.alias("collections"), F.lit(limit).cast("long").alias("limit")).join(sizes, "query_id", "left")
    out = out.withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    if words is not None:
        none = F.array().cast("array<struct<word:string,count:bigint>>")
        out = out.join(word_list(words), "query_id", "left").withColumn("matched_words", F.coalesce("matched_words", none))
    return out if logic is None else out.join(logic, "query_id", "left")


def ranked_summary(queries: DataFrame, rows: DataFrame, mode: str, limit: int, how: dict, collections: list[str] | None = None, logic: DataFrame | None = None) -> DataFrame:
    """The summary of ranked rows: the pool's size bounds the limit, and an empty pool has been ranked by nothing."""
    out = summary(queries, rows, fusion.chip_words(rows), limit, collections, logic).withColumn("mode_hint", F.lit(mode))
    some = F.col("total") > 0
    status = F.when(some, F.lit(how["reranker_status"])).otherwise("disabled" if how["reranker_status"] == "disabled" else "ok")
    added = {
        "pool_size": F.col("total"), "limit": F.when(some, F.least("limit", "total")).otherwise(F.col("limit")), "reranker": F.when(some, F.lit(how["reranker"])).otherwise("none"),
        "reranker_active": some & F.lit(how["reranker_active"]), "reranker_status": status, "threshold": F.when(some, F.lit(how["threshold"]).cast("double")),
    }
    return out.withColumns(added)


def shown(rows: DataFrame, corpus: DataFrame, queries: DataFrame, titles: DataFrame | None, snippet: Callable, *more: str) -> DataFrame:
    """Rows (query_id, rank, corpus_idx, ...) as they are shown: title, numbers, grade and snippet(text, query)."""
    text = corpus.select("corpus_idx", "collection", "id_in_book", "number", "grade", "text")
    out = text.join(settled(rows.select("query_id", "rank", "corpus_idx", *more)), "corpus_idx").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    title = F.col("collection")
    if titles is not None:
        out = out.join(settled(titles.select(F.col("slug").alias("collection"), "english_title")), "collection", "left")
        title = F.coalesce("english_title", "collection")
    return out.select("query_id", "rank", "corpus_idx", "collection", title.alias("title"), "id_in_book", "number", "grade", *more, snippet(F.col("text"), F.col("query")).alias("snippet"))


@dataclass
class Engine:
    """The corpus with its indexes. embeddings may be None; encoder turns query texts into vectors.

    A plain search of one leg (respond_keyword, _term, _semantic without ranking) needs that leg's index only.
    """

    corpus: DataFrame
    keyword: bm25.Index | None
    terms: term.Index | None
    embeddings: DataFrame | None = None
    encoder: Callable[[list[str]], list[list[float]]] | None = None
    titles: DataFrame | None = None

    def checked(self, limit: int, collections: list[str] | None) -> int:
        if collections:
            known = {r[0] for r in self.corpus.where(F.col("collection").isin(collections)).select("collection").distinct().collect()}
            for slug in collections:
                if slug not in known:
                    raise SearchError("unknown_collection", f"unknown collection {slug!r}")
        return min(max(limit, LEAST_LIMIT), MOST_LIMIT)

    def queries(self, *texts: str) -> DataFrame:
        return self.corpus.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")

    def vectors(self, queries: DataFrame) -> DataFrame | None:
        """Query vectors, computed on the driver, so for dense.MOST_QUERIES at most; None without embeddings or an encoder."""
        if self.embeddings is None or self.encoder is None:
            return None
        rows = queries.limit(dense.MOST_QUERIES + 1).collect()
        if len(rows) > dense.MOST_QUERIES:
            raise ValueError(f"more than {dense.MOST_QUERIES} texts to encode: encode them on executors and use dense.top")
        found = self.encoder([r["text"] for r in rows])
        unit = [[x / (sum(v * v for v in vec) ** 0.5 or 1.0) for x in vec] for vec in found]
        return self.corpus.sparkSession.createDataFrame([(r["query_id"], [float(x) for x in v]) for r, v in zip(rows, unit, strict=True)], "query_id long, query array<double>")

    def legs(self, queries: DataFrame, k: int = 100, collections: list[str] | None = None):
        """The three legs' best k rows of each query; blank queries have none."""
        asked = queries.where(F.trim("text") != "")
        words = bm25.top(bm25.scores(self.keyword, asked), k, self.corpus, collections)
        skeleton = bm25.top(term.scores(term.hits(self.terms, asked)), k, self.corpus, collections)
        vectors, near = self.vectors(asked), None
        if vectors is not None:
            table = dense.with_content(self.embeddings, self.corpus)
            if collections:
                table = table.join(self.corpus.where(F.col("collection").isin(collections)).select("corpus_idx"), "corpus_idx", "left_semi")
            near = dense.top(table, vectors, k)
        return words, near, skeleton

    def pool(self, queries: DataFrame, k: int = 100, collections: list[str] | None = None) -> DataFrame:
        return fusion.union(*self.legs(queries, k, collections))

    def ranked(self, queries: DataFrame, pool: DataFrame, mode: str, limit: int, reranker: rerank.Reranker | None = None) -> tuple[DataFrame, dict]:
        scored, name, status, threshold = rerank.scored_pool(pool, self.corpus, queries, mode, reranker or rerank.configured())
        rows = fusion.split(scored, limit, threshold)
        return fusion.hydrate(rows, self.corpus, queries, self.titles), {"mode": mode, "reranker": name, "reranker_status": status, "reranker_active": status == "ok", "threshold": threshold}

    def search(self, text: str, mode: str = "concept", collections: list[str] | None = None, limit: int = 10, k: int = 100, reranker: rerank.Reranker | None = None) -> tuple[DataFrame, dict]:
        """Rows, strong and weak, and what ranked them: the reranker given, or the one that the environment names, or weights.

        The pool has at most k rows a leg, whatever the limit.
        """
        fusion.mode_weights(mode)
        limit = self.checked(limit, collections)
        queries = self.queries(text)
        return self.ranked(queries, self.pool(queries, k, collections), mode, limit, reranker)

    def respond(self, queries: DataFrame, mode: str = "concept", collections: list[str] | None = None, limit: int = 10, k: int = 100, reranker: rerank.Reranker | None = None) -> Response:
        """Ranked rows and their summary for many queries; without a reranker the one that the environment names."""
        fusion.mode_weights(mode)
        limit = self.checked(limit, collections)
        scored, name, status, threshold = rerank.scored_pool(self.pool(queries, k, collections), self.corpus, queries, mode, reranker or rerank.configured())
        rows = fusion.split(scored, limit, threshold)
        how = {"reranker": name, "reranker_status": status, "reranker_active": status == "ok", "threshold": threshold}
        said = term.logic(term.hits(self.terms, queries), queries, self.corpus, collections) if mode == "term" else None
        return Response(fusion.hydrate(rows, self.corpus, queries, self.titles), ranked_summary(queries, rows, mode, limit, how, collections, said))

    def respond_keyword(self, queries: DataFrame, collections: list[str] | None = None, limit: int = 10, rerank_rows: bool = True) -> Response:
        """Keyword search: ranked as any search, or by tier, grade and score."""
        if rerank_rows:
            return self.respond(queries, "keyword", collections, limit)
        limit = self.checked(limit, collections)
        rows = bm25.tiered(bm25.scores(self.keyword, queries), self.corpus, limit, collections=collections)
        return Response(shown(rows, self.corpus, queries, self.titles, T.snippet), summary(queries, rows, None, limit, collections, total="total"))

    def respond_term(self, queries: DataFrame, collections: list[str] | None = None, limit: int = 20, rerank_rows: bool = True) -> Response:
        """Term search: ranked as any search, or by tier, grade and ordinal, with the words of all matches."""
        if rerank_rows:
            return self.respond(queries, "term", collections, limit)
        limit = self.checked(limit, collections)
        found = term.hits(self.terms, queries)
        matched = term.matches(found)
        if collections:
            matched = matched.join(self.corpus.where(F.col("collection").isin(collections)).select("corpus_idx"), "corpus_idx", "left_semi")
        rows = term.by_row(found, self.corpus, limit, collections)
        said = term.logic(found, queries, self.corpus, collections)
        return Response(shown(rows, self.corpus, queries, self.titles, lambda text, _: T.head(text, 140), "matched_words"), summary(queries, rows, term.word_counts(matched), limit, collections, said, "total"))

    def respond_semantic(self, queries: DataFrame, collections: list[str] | None = None, limit: int = 10, rerank_rows: bool = True) -> Response:
        """Dense search: ranked as any search, or by tier, grade and similarity; SearchError of kind unavailable without vectors."""
        if self.embeddings is None or self.encoder is None:
            raise SearchError("unavailable", "no embeddings or no encoder")
        if rerank_rows:
            return self.respond(queries, "concept", collections, limit)
        limit = self.checked(limit, collections)
        rows = self._near(queries, collections, limit).withColumnRenamed("score", "similarity")
        return Response(shown(rows, self.corpus, queries, self.titles, lambda text, _: T.head(text, 200), "similarity"), summary(queries, rows, None, limit, collections))

    def _near(self, queries: DataFrame, collections: list[str] | None, limit: int) -> DataFrame:
        table = dense.with_content(self.embeddings, self.corpus)
        if collections:
            table = table.join(self.corpus.where(F.col("collection").isin(collections)).select("corpus_idx"), "corpus_idx", "left_semi")
        return dense.oversampled(dense.top(table, self.vectors(queries), dense.pool_size(limit)), self.corpus, limit)

    def keyword_search(self, text: str, collections: list[str] | None = None, limit: int = 10) -> DataFrame:
        return bm25.tiered(bm25.scores(self.keyword, self.queries(text)), self.corpus, self.checked(limit, collections), collections=collections)

    def term_search(self, text: str, collections: list[str] | None = None, limit: int = 20) -> DataFrame:
        queries = self.queries(text)
        found = term.hits(self.terms, queries)
        said = term.logic(found, queries, self.corpus, collections)
        return term.by_row(found, self.corpus, self.checked(limit, collections), collections).join(said, "query_id")

    def semantic_search(self, text: str, collections: list[str] | None = None, limit: int = 10) -> DataFrame:
        limit = self.checked(limit, collections)
        if self.embeddings is None or self.encoder is None:
            raise SearchError("unavailable", "no embeddings or no encoder")
        return self._near(self.queries(text), collections, limit)

    def natural(self, text: str, router: route.Router | None, collections: list[str] | None = None, limit: int = 10, k: int = 100, reranker: rerank.Reranker | None = None, deadline: float = route.DEADLINE) -> tuple[DataFrame, dict]:
        """A question through a router's variants, merged by reciprocal rank in one plan; without an answer in time a plain search.

        The router is called on the driver and gives (mode, variants); of these the first
        three that are not blank count. A mode that searches do not know becomes concept.
        """
        limit = self.checked(limit, collections)
        said = route.ask(router, [text], deadline)[0] if router is not None else None
        if said is None:
            rows, how = self.search(text, "concept", collections, limit, k, reranker)
            return rows, how | {"variants": [], "fallback": "llm_unavailable" if router is None else "router_failed"}
        mode, variants = said
        pools = self.pool(self.queries(*variants), k, collections).withColumnRenamed("query_id", "variant_id").withColumn("query_id", F.lit(0).cast("long"))
        rows, how = self.ranked(self.queries(text), fusion.reciprocal_rank(pools), mode, limit, reranker)
        return rows, how | {"variants": variants, "fallback": None}

    def respond_natural(self, questions: DataFrame, router: Callable[[], route.Router] | None, collections: list[str] | None = None, limit: int = 10, k: int = 100, reranker: rerank.Reranker | None = None, deadline: float = route.DEADLINE, at_once: int = route.AT_ONCE) -> Response:
        """Many questions through a router in one plan: rows of all, and a summary that has mode, variants and fallback of each.

        router() gives the function, once a task, which is asked on executors. A question without an answer in time is
        searched as it is, in concept mode.
        """
        limit = self.checked(limit, collections)
        said = route.answers(questions, router, deadline, at_once)
        each = said.select("query_id", F.posexplode("variants").alias("n", "text")).withColumn("variant_id", F.col("query_id") * (route.MOST_VARIANTS + 1) + F.col("n"))
        pools = self.pool(each.select(F.col("variant_id").alias("query_id"), "text"), k, collections).withColumnRenamed("query_id", "variant_id")
        pools = pools.withColumn("query_id", F.floor(F.col("variant_id") / (route.MOST_VARIANTS + 1)))
        merged, queries = fusion.reciprocal_rank(pools), said.select("query_id", "text")
        reranker = reranker or rerank.configured()
        scored, name, status, threshold = rerank.scored_pool(merged, self.corpus, queries, "concept", reranker)
        if status != "ok":  # weights are those of each question's own mode
            scored = fusion.weighted_by_mode(merged, said.select("query_id", "mode"))
        rows = fusion.split(scored, limit, threshold)
        how = {"reranker": name, "reranker_status": status, "reranker_active": status == "ok", "threshold": threshold}
        told = said.select("query_id", F.col("mode").alias("mode_hint"), F.when(F.col("fallback").isNull(), F.col("variants")).otherwise(F.array().cast("array<string>")).alias("variants"), "fallback")
        return Response(fusion.hydrate(rows, self.corpus, queries, self.titles), ranked_summary(queries, rows, "concept", limit, how, collections).drop("mode_hint").join(told, "query_id"))
