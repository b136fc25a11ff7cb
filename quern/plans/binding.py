"""The retrieval model over the tables at hand: documents as corpus, labels as grades, embeddings as vectors.

collection = source, book = lang, corpus_idx = doc_id, tier = the number in the source's
name. Numbers are made from the id in the three forms that numbers have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.ordinal import numbered
from quern.sources.kept import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLACES: dict[tuple, DataFrame] = {}


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and id_in_book, numbered once a session and table set, by keys alone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLACES:
        keys = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
        _PLACES[key] = kept(numbered(keys, "source", [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first()], "id_in_book").select("doc_id", "id_in_book"), "places")
    return _PLACES[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    grade = F.when((q == 1) & (t == 0), "Sahīh (reviewed)").when((q == 1) & (t == 1), "Hasan").when((q == 0) & (t == 0), "Da'if").when((q == 0) & (t == 1), '[{"grade": "Maudu"}]').otherwise("")
    n = F.col("doc_id") % 400
    number = F.when(F.col("doc_id") % 3 == 0, n.cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(n.cast("string"), F.lit(" a"))).otherwise(F.concat(n.cast("string"), F.lit(", "), (n + 1).cast("string")))
    docs = docs.join(_places(spark, sf_dir), "doc_id")
    return docs.select(
        F.col("doc_id").alias("corpus_idx"), F.col("source").alias("collection"), F.col("lang").alias("book"), "id_in_book", number.alias("number"), "text", grade.alias("grade"),
        T.grade_tier(T.grade_class(grade)).alias("grade_tier"), F.coalesce(F.expr("try_cast(substr(source, 4) AS int)"), F.lit(99)).alias("tier"),
    )


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, english_title of the sources that have an even number; the others have no title."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).distinct().where("try_cast(substr(slug, 4) AS int) % 2 = 0").select("slug", F.concat(F.lit("Sahih "), F.upper("slug")).alias("english_title"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("corpus_idx"), "embedding")


ARABIC = ["صَلَاة", "قُنُوت", "رمضان", "دعاء", "أذان", "نية", "ذكر"]


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a source table, with books, chapters, narrator lines and marked-up Arabic made from the id."""
    i, arabic = F.col("doc_id"), F.array(*(F.lit(w) for w in ARABIC))
    word = lambda n: F.element_at(arabic, (n % len(ARABIC) + 1).cast("int"))
    n = i % 400
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("collection"), (i % 12).cast("string").alias("bookNumber"), F.when(i % 7 != 0, (i % 3) + 0.5).alias("babID"),
        F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("On "), F.col("lang"), F.lit(" "), (i % 3).cast("string"))).alias("englishBabName"), F.when(i % 2 == 0, "باب").alias("arabicBabName"),
        F.when(i % 11 == 0, "").otherwise(F.concat(n.cast("string"), F.when(i % 3 == 1, " a").otherwise(""))).alias("hadithNumber"), i.alias("arabicURN"), (i + 1_000_000).alias("englishURN"),
        F.concat(F.lit("[prematn]"), word(i), F.lit(' [narrator id="'), (i % 50).cast("string"), F.lit('" role="first" tooltip=""] '), word(i + 2), F.lit(" [/narrator][/prematn] "), word(F.floor(i / 3))).alias("arabicText"),
        F.concat(F.when(i % 4 == 0, F.concat(F.lit("Narrated "), F.col("lang"), F.lit(":\n"))).otherwise(""), F.col("text")).alias("englishText"),
        F.element_at(F.array(*(F.lit(g) for g in GRADED)), (i % 4 + 1).cast("int")).alias("englishgrade1"), F.lit("").alias("arabicgrade1"),
    )


GRADED = ["Sahih", "Hasan", "", "Da'if"]


def source_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as known collections: slug, load_order and tier (the number in the name), english_title."""
    number = F.expr("try_cast(substr(slug, 4) AS int)")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).distinct().where(number.isNotNull()).select("slug", number.alias("load_order"), number.alias("tier"), F.concat(F.lit("Sahih "), F.upper("slug")).alias("english_title"))


def arabic_word(n: str) -> str:
    """SQL of the word that source() takes for a number."""
    return f"([{', '.join(repr(w) for w in ARABIC)}])[({n}) % {len(ARABIC)} + 1]"


SOURCE_SQL = f"""
src AS (
  SELECT source AS collection, CAST(doc_id % 12 AS VARCHAR) AS book, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 + 0.5::DOUBLE END AS bab,
    CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'On ' || lang || ' ' || (doc_id % 3) END AS title, CASE WHEN doc_id % 2 = 0 THEN 'باب' END AS arabic_title,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE (doc_id % 400) || (CASE WHEN doc_id % 3 = 1 THEN ' a' ELSE '' END) END AS number, doc_id, doc_id + 1000000 AS urn,
    '[prematn]' || {arabic_word("doc_id")} || ' [narrator id="' || (doc_id % 50) || '" role="first" tooltip=""] ' || {arabic_word("doc_id + 2")} || ' [/narrator][/prematn] ' || {arabic_word("doc_id // 3")} AS arabic,
    (CASE WHEN doc_id % 4 = 0 THEN 'Narrated ' || lang || ':' || chr(10) ELSE '' END) || text AS t, lang,
    (['Sahih', 'Hasan', '', 'Da''if'])[doc_id % 4 + 1] AS grade, ([0, 2, 4, 3])[doc_id % 4 + 1] AS grade_tier, TRY_CAST(substr(source, 4) AS INTEGER) AS tier
  FROM documents
),
built AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY collection ORDER BY CAST(book AS INTEGER), book, bab NULLS FIRST, doc_id) AS INTEGER) AS id_in_book,
    row_number() OVER (ORDER BY tier, CAST(book AS INTEGER), book, bab NULLS FIRST, doc_id) - 1 AS corpus_idx
  FROM src WHERE tier IS NOT NULL
)"""

CORPUS_SQL = """
lab AS (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY doc_id),
corpus AS (
  SELECT d.doc_id AS corpus_idx, d.source AS collection, d.lang AS book, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.lang, d.doc_id) AS INTEGER) AS id_in_book,
    CASE d.doc_id % 3 WHEN 0 THEN CAST(d.doc_id % 400 AS VARCHAR) WHEN 1 THEN (d.doc_id % 400) || ' a' ELSE (d.doc_id % 400) || ', ' || (d.doc_id % 400 + 1) END AS number,
    d.text,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'Sahīh (reviewed)' WHEN quality = 1 AND toxic = 1 THEN 'Hasan' WHEN quality = 0 AND toxic = 0 THEN 'Da''if' WHEN quality = 0 AND toxic = 1 THEN '[{"grade": "Maudu"}]' ELSE '' END AS grade,
    CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 2 WHEN quality = 0 AND toxic = 0 THEN 3 WHEN quality = 0 AND toxic = 1 THEN 5 ELSE 4 END AS grade_tier,
    coalesce(TRY_CAST(substr(d.source, 4) AS INTEGER), 99) AS tier
  FROM documents d LEFT JOIN lab USING (doc_id)
)"""
