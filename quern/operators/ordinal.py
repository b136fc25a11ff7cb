"""Places in groups without a task that has a group: ranges of the whole order, and sums of counts before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.kept import kept


def numbered(keys: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """keys with `name`: each row's place, from 1, among the rows of its group by order.

    Rows are sorted by ranges of (group, order), so a group that has a third of all rows is many ranges. A row's place is
    its place in its range, less where its group begins there, plus the group's rows in the ranges before: a
    window over one row a range and group. Rows of equal order lie in one range. Null groups are a group.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    ranged = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()  # the range's number, and the row's place in it
    held = kept(ranged.withColumn("__at", at).withColumns({"__range": F.shiftright(F.col("__at"), 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}), "ordinals")
    parts = held.groupBy("__range", F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a range and group; those of one range are joined by its number first, so a hot group is as many keys as it has ranges
    starts = parts.select(F.col("__range").alias("__of"), "__group", "__first", before.alias("__before"))
    out = held.join(starts, (F.col("__range") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*keys.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("int").alias(name))
