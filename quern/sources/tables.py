"""Tables on disk: the corpus, embeddings with their checks, query sets and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators.corpus import SearchError


def write_table(rows: DataFrame, path: str, key: str, partition: str = "collection") -> int:
    """Replace the table at path, by collection; the key must be unique and all rows must arrive.

    The rows are computed once: they are counted as they go out, and what has been written beside the table is
    counted and its keys compared before it takes the table's place. A table that fails leaves the old one.
    """
    spark, aside = rows.sparkSession, f"{path.rstrip('/')}-aside-{uuid.uuid4().hex}"
    sent = Observation()
    rows.observe(sent, F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).write.partitionBy(partition).parquet(aside)
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        found = spark.read.parquet(aside) if sent.get["n"] else rows.limit(0)
        again = found.groupBy(key).count().where("count > 1").select(key).limit(1).collect() if not sent.get["nulls"] else [[None]]
        if again:
            raise ValueError(f"{key} {again[0][0]!r} is not unique or is null")
        written = found.count()
        if written != sent.get["n"]:
            raise RuntimeError(f"{sent.get['n']} rows went out, {written} arrived")
        files.delete(old, True)
        if not files.rename(new, old):
            raise RuntimeError(f"the table is at {aside}: it could not be moved to {path}")
    except ValueError:
        files.delete(new, True)
        raise
    return written


def load_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "collection")


def fingerprint(corpus: DataFrame, text) -> str:
    """A digest of every row's number and text, whatever order they are read in."""
    row = corpus.agg(F.bit_xor(F.xxhash64("corpus_idx", F.sha2(text, 256))).alias("x"), F.sum(F.pmod(F.xxhash64(F.sha2(text, 256), "corpus_idx"), F.lit(1 << 30))).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['x'] or 0:x}:{row['s'] or 0:x}"


def write_embeddings(vectors: DataFrame, path: str, model: str, mark: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    kept = vectors.sparkSession.read.parquet(f"{path}/vectors")
    size = kept.agg(F.count(F.lit(1)).alias("vector_count"), F.max(F.size("embedding")).alias("dim"))
    size.select(F.lit(model).alias("model_id"), "vector_count", "dim", F.lit(mark).alias("corpus_fingerprint"), F.lit(True).alias("normalized")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_embeddings(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """The vectors, if there are as many as were written and the corpus is the one they were made of."""
    try:
        meta = spark.read.json(f"{path}/meta").first()
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception as e:
        raise SearchError("unavailable", f"no embeddings at {path}") from e
    if vectors.count() != meta["vector_count"]:
        raise RuntimeError(f"{vectors.count()} vectors, not {meta['vector_count']}")
    if mark is not None and mark != meta["corpus_fingerprint"]:
        raise RuntimeError("the embeddings are of another corpus")
    return vectors


def read_query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, text, mode) and relevant(query_id, collection, number) of a JSON query set."""
    rows = spark.read.schema("queries array<struct<query:string,mode_hint:string,relevant:array<struct<collection:string,hadith_number:string>>>>").json(path, multiLine=True)
    each = rows.select(F.posexplode("queries").alias("query_id", "q")).withColumn("query_id", F.col("query_id").cast("long"))
    relevant = each.select("query_id", F.explode("q.relevant").alias("r")).select("query_id", "r.collection", F.col("r.hadith_number").alias("number"))
    return each.select("query_id", F.col("q.query").alias("text"), F.coalesce("q.mode_hint", F.lit("concept")).alias("mode")), relevant


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
