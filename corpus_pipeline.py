"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. A caller may write each stage's result and read it again as
the next one's docs; run() does so in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, mixing, ngram_join, packing, quality
from quern.llm.common import as_long, drop_but, keep, kept_paths, small, text_column
from quern.session import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of rows that are not held out.

    A null text is scored as an empty one. Repeated rows have equal scores and go or stay together. A score
    of exactly 0.5 is accepted. Without labels of both kinds all rows have one score. No rows give none.
    """
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("quality_predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the largest doc_id, of each group of equal texts.

    A null text equals an empty one; a null id is the least. Of rows with equal id and text one stays. No rows give none.
    """
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of similar texts; texts without words are alike to none.

    Rows go by id and text, so another text of a removed row's id stays if it is itself alike to none. A null
    id is the greatest. Of equal ids in a group the least hash of the text stays, with all rows equal to it.
    """
    ship(spark)
    groups = ngram_join.row_groups(docs)
    gone = keep(groups.where("not first").select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")).distinct(), "pipeline-gone")
    of = as_long(docs).eqNullSafe(gone["__gone"]) & (F.xxhash64(text_column(docs)) == gone["__hash"])
    return docs.join(small(gone), of, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the text is cut where it takes a part.

    Texts that are null or without words have no size and are never taken. A null source is one by itself.
    Rows of one id are taken alike. n_chars, where docs have it, is that of the text taken. No rows give none.
    """
    ship(spark)
    mixed = mixing.mix(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and its place there.

    A null text is packed as its end token alone; repeated rows are packed once each. No rows give none.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: The classifier, the hash-ordered mix and the tokeniser are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = kept_paths()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_but(others, docs)  # what the stage kept for itself, and the documents it read
    return STAGES[-1][1](spark, docs, sf_dir)
