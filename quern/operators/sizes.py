"""Broadcasts only of what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are taken to the driver and back to be broadcast, at most; more are joined by a shuffle.
MOST_ROWS = 10_000


def settled(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df as a local table with a broadcast hint if it has at most so many rows, else as it is. It is computed here, once."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


#: From this count on a key is frequent, unless a share of all rows is more: so few keys are.
FREQUENT, SHARE = 1000, 100_000


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """many joined with one on key, where one's column `count` says how many rows of many each of its keys meets.

    A key of more than a SHARE-th of all rows is dealt into parts of so many, by a hash of the row, and one's rows
    of it go to each part; the number of parts is broadcast for those keys only, of which there are at most SHARE. So no
    task has a hot key, and many is read once.
    """
    most = max(FREQUENT, rows // SHARE)
    parts = F.ceil(F.col(count) / most).cast("int").alias("__parts")
    hot = F.broadcast(one.where(F.col(count) > most).select(F.col(key).alias("__key"), parts).distinct())
    part = F.pmod(F.xxhash64(*many.columns), F.coalesce("__parts", F.lit(1))).cast("int").alias("__part")
    dealt = many.join(hot, F.col(key) == F.col("__key"), "left").select(*many.columns, part)
    sent = one.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / most), F.lit(1)).cast("int") - 1)))
    return dealt.join(sent, [key, "__part"]).drop("__part")
