"""Exact duplicates by deterministic block naming (DataFrame functions only).

A text, A-Z lower-cased, is cut into blocks of a fixed number of bytes. The distinct
blocks are sorted and numbered, which gives equal blocks one integer name and
different blocks different names. Adjacent pairs of names are then named in the same
way, level by level, until each document has one name. Names come from whole blocks
and whole pairs, never from a hash, so no collision can join two texts. A SHA-256 of
each block only carries its name back to the documents; if two distinct blocks ever
share one, the blocks themselves are the join key instead.

Only distinct block contents are shuffled, after a map-side combine, so a block that
a third of all documents hold costs one row a task. Names come with the number of rows
that they go back to: hot blocks, hot pairs and hot groups are broadcast to where their
rows are, and only the others' rows are shuffled, never many of them to one task.

Nulls: a null text is empty; a null doc_id sorts below every other. Repeated rows are
copies like any other, and exactly one row of a group stays, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_long, drop, join_hot, keep, small, text_column

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters outside A-Z that lower() would change.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
BLOCK_BYTES = 4096


def sha(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def _blocks(of: Column, size: int, use: Callable[[Column], Column]) -> Column:
    last = F.greatest(F.floor((F.length(of) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: use(F.substring(of, i * size + 1, F.lit(size))))


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows in sorted order with an integer name and their number each; to be kept, so that names never change."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("held")).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = sha
) -> DataFrame:
    """row, doc_id, text_sha256, level, name: rows have equal texts exactly if level and name are equal."""
    lower = docs.select(as_long(docs, id_col).alias("doc_id"), F.encode(normalised(text_column(docs, text_col)), "UTF-8").alias("body"))
    rows = keep(
        lower.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("body", 256).alias("text_sha256"), _blocks(F.col("body"), block_bytes, digest).alias("digests")),
        "exact-rows",
    )
    blocks = lower.select(F.explode(_blocks(F.col("body"), block_bytes, lambda b: b)).alias("block"))
    names = keep(_named(blocks, ["block"]).select(digest(F.col("block")).alias("digest"), "name", "held"), "exact-names")
    total = names.agg(F.sum("held")).first()[0] or 0
    if names.groupBy("digest").count().where("count > 1").limit(1).count():
        content = keep(_named(blocks, ["block"]), "exact-contents")
        again = keep(lower.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.sha2("body", 256).alias("text_sha256"), "body"), "exact-rows")
        rows = again.select("row", "doc_id", "text_sha256", _blocks(F.col("body"), block_bytes, digest).alias("digests"))
        level = again.withColumn("parts", _blocks(F.col("body"), block_bytes, lambda b: b)).select("row", F.size("parts").alias("left"), F.posexplode("parts").alias("at", "block"))
        level = keep(join_hot(level, content, ["block"], "held", total).select("row", "left", "at", "name"), "exact-level")
    else:
        level = rows.select("row", F.size("digests").alias("left"), F.posexplode("digests").alias("at", "digest"))
        level = keep(join_hot(level, names, ["digest"], "held", total).select("row", "left", "at", "name"), "exact-level")
    done, depth = [], 0
    most = rows.agg(F.max(F.size("digests"))).first()[0] or 0
    while True:
        done.append(level.where("left = 1").select("row", F.lit(depth).alias("level"), "name"))
        if most <= 1:
            break
        half = F.floor(F.col("at") / 2).cast("int")
        even = F.col("at") % 2 == 0
        pairs = level.where("left > 1").groupBy("row", half.alias("at")).agg(
            F.first("left").alias("left"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = keep(pairs, "exact-pairs")
        named = keep(_named(pairs, ["a", "b"]), "exact-names")
        level = keep(join_hot(pairs, named, ["a", "b"], "held", pairs.count()).select("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), "at", "name"), "exact-level")
        drop(pairs, named)
        most, depth = -(-most // 2), depth + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.select("row", "doc_id", "text_sha256").join(found, "row")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = keep(identities(docs, **options), "exact-identities")
    groups = found.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(groups, "exact-groups")
    return join_hot(found, groups, ["level", "name"], "group_size", found.count()).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one row of each group of equal texts, its columns untouched."""
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, **options)
    by = keep(groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "exact-decisions")
    tagged = docs.withColumns({"__id": as_long(docs, id_col), "__sha": F.sha2(F.encode(normalised(text_column(docs, text_col)), "UTF-8"), 256)})

    def match(side: DataFrame):
        return tagged["__id"].eqNullSafe(side["doc_id"]) & (tagged["__sha"] == side["text_sha256"])

    many = by.where("kept and rows > 1")
    single = small(by.where("not kept or rows > 1"))
    out = tagged.join(single, match(single), "left_anti").drop("__id", "__sha")
    if many.limit(1).count():
        side = small(many)
        again = tagged.join(side, match(side), "left_semi").dropDuplicates(["__id", "__sha"]).drop("__id", "__sha")
        out = out.unionByName(again)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
