"""Terms by consonant skeleton: postings, intersection with a fallback to union, and scores by rarity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.sizes import join_counted
from quern.sources.kept import kept


@dataclass
class Index:
    """held(word, corpus_idx), words(word, df) and folded(skeleton, word, df): skeletons are a word's, not a posting's."""

    held: DataFrame
    words: DataFrame
    folded: DataFrame

    @property
    def postings(self) -> DataFrame:
        """skeleton, corpus_idx, word, df; a word that many rows hold is dealt into parts."""
        rows = self.words.agg(F.sum("df")).first()[0] or 0
        return join_counted(self.held, self.folded, "word", "df", rows).select("skeleton", "corpus_idx", "word", "df")

    def write(self, path: str) -> None:
        """held is laid out by word and row, so a query's words prune row groups and a frequent one is many files; words are counted from it."""
        read = self.held.sparkSession.read
        self.held.repartitionByRange("word", "corpus_idx").sortWithinPartitions("word", "corpus_idx").write.mode("overwrite").parquet(f"{path}/held")
        _counted(read.parquet(f"{path}/held")).write.mode("overwrite").parquet(f"{path}/words")
        _folded(read.parquet(f"{path}/words")).repartitionByRange("skeleton").sortWithinPartitions("skeleton").write.mode("overwrite").parquet(f"{path}/folded")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("held", "words", "folded")))


#: Query skeletons, and the words that they find, that are looked up as literals; more are joined.
MOST_LITERALS = 2000


def _counted(held: DataFrame) -> DataFrame:
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def _folded(words: DataFrame) -> DataFrame:
    return words.select(F.explode(T.index_skeletons(F.col("word"))).alias("skeleton"), "word", "df")


def build(corpus: DataFrame, words: Callable[[Column], Column] = T.arabic_words, column: str = "arabic") -> Index:
    """Each row's distinct words, markup attributes included, read once; skeletons are made once a distinct word."""
    each = kept(corpus.select("corpus_idx", F.array_distinct(words(F.col(column))).alias("words")), "words")
    held = each.select(F.explode("words").alias("word"), "corpus_idx")
    return Index(held, _counted(held), _folded(_counted(held)))


def hits(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, token (its place in the query), corpus_idx, word, df; tokens that find nothing drop out.

    A word that two of a token's skeletons find stands twice; what counts hits counts distinct ones.
    """
    asked = queries.select("query_id", F.posexplode(T.query_words(F.col("text"))).alias("token", "w")).select("query_id", "token", F.explode(T.query_skeletons(F.col("w"))).alias("skeleton"))
    folded = index.folded
    few = asked.limit(MOST_LITERALS + 1).collect()
    if len(few) <= MOST_LITERALS:
        asked = F.broadcast(asked.sparkSession.createDataFrame(few, asked.schema))
        folded = folded.where(F.col("skeleton").isin(sorted({r["skeleton"] for r in few})))
    found = folded.join(asked, "skeleton").select("query_id", "token", "word", "df")
    few = found.limit(MOST_LITERALS + 1).collect()
    if len(few) <= MOST_LITERALS:
        near = F.broadcast(found.sparkSession.createDataFrame(few, found.schema))
        out = index.held.where(F.col("word").isin(sorted({r["word"] for r in few}))).join(near, "word")
    else:
        out = join_counted(index.held, found, "word", "df", index.words.agg(F.sum("df")).first()[0] or 0)
    return out.select("query_id", "token", "corpus_idx", "word", "df")


def rows(found: DataFrame) -> DataFrame:
    """query_id, corpus_idx, words (word, df) of the rows that match: all surviving tokens of a query, or any where no row has all."""
    per_row = found.groupBy("query_id", "corpus_idx").agg(F.collect_set("token").alias("tokens"), F.collect_set(F.struct("word", "df")).alias("words"))
    per_query = per_row.groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("all"), F.max(F.size("tokens")).alias("most"))
    return per_row.join(per_query, "query_id").where((F.size("tokens") == F.col("all")) | (F.col("most") < F.col("all"))).select("query_id", "corpus_idx", "words")


def matches(found: DataFrame) -> DataFrame:
    """query_id, corpus_idx, word, df: the matching rows' words, one a row."""
    return rows(found).select("query_id", "corpus_idx", F.explode("words").alias("w")).select("query_id", "corpus_idx", "w.word", "w.df")


def scores(found: DataFrame) -> DataFrame:
    """query_id, corpus_idx, score, matched_words (sorted) of hits: rarer words count more."""
    score = F.aggregate("words", F.lit(0.0), lambda s, w: s + 1.0 / F.ln(w["df"] + 2))
    return rows(found).select("query_id", "corpus_idx", F.round(score, 6).alias("score"), F.array_sort(F.transform("words", lambda w: w["word"])).alias("matched_words"))


def word_counts(matched: DataFrame) -> DataFrame:
    """In how many matching rows each word stands, before any limit."""
    return matched.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))


def logic(found: DataFrame, queries: DataFrame, corpus: DataFrame | None = None, collections: list[str] | None = None) -> DataFrame:
    """query_id and match_logic: and, and_fallback_to_or, or null without a usable token.

    The collection filter comes before the intersection here, and after it in matches():
    a filtered query can say "and" for rows that the search, judging over all, leaves out.
    """
    if collections:
        found = found.join(corpus.where(F.col("collection").isin(collections)).select("corpus_idx"), "corpus_idx", "left_semi")
    per_row = found.groupBy("query_id", "corpus_idx").agg(F.countDistinct("token").alias("n")).groupBy("query_id").agg(F.max("n").alias("most"))
    tokens = found.groupBy("query_id").agg(F.countDistinct("token").alias("tokens"))
    said = F.when(F.col("most") == F.col("tokens"), "and").otherwise("and_fallback_to_or")
    return queries.select("query_id").join(per_row.join(tokens, "query_id").select("query_id", said.alias("match_logic")), "query_id", "left")


def by_row(found: DataFrame, corpus: DataFrame, limit: int, collections: list[str] | None = None) -> DataFrame:
    """All matches by tier, grade and ordinal, with their total."""
    rows = scores(found).join(corpus.select("corpus_idx", "collection", "tier", "grade_tier", "id_in_book"), "corpus_idx")
    if collections:
        rows = rows.where(F.col("collection").isin(collections))
    total = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "grade_tier", "id_in_book", "corpus_idx"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).join(total, "query_id")
