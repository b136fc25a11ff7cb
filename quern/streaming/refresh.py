"""Refreshing a table as new source files arrive: each file is taken once, then the stream ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.streaming.segments import Store


def refresh(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, rebuild: Callable[[DataFrame, int], None], form: str = "parquet") -> int:
    """Give rebuild(rows, batch) the rows of files that no earlier call has seen; the number of batches that had rows.

    The checkpoint remembers the files, so an unchanged source costs a listing. rebuild
    must be safe to repeat for a batch number.
    """
    ran: list[int] = []

    def each(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            rebuild(rows, batch)
            ran.append(batch)

    query = spark.readStream.format(form).schema(schema).load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


def chained(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, store: Store, encoder=None, form: str = "parquet", snapshot: bool = False) -> list[dict]:
    """Take new source files into a store: table, keyword index and vectors follow from the rows that changed; what each batch changed.

    A batch is named by its checkpoint and number, so one that ran before a failure and is given again is known to the store.
    """
    said: list[dict] = []
    refresh(spark, source, schema, checkpoint, lambda rows, batch: said.append(store.apply(rows, f"{checkpoint}#{batch}", encoder, snapshot)), form)
    return said
