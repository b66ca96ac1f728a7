"""Running state of a key over an order, carried from bucket to bucket, so that no task needs all rows of a busy key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _earlier(*by: str) -> Window:
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def sum_before(frame: DataFrame, by: list[str], bucket: str, order: list[Column | str], value: Column, name: str = "before") -> DataFrame:
    """frame with the sum of ``value`` over the earlier rows of its key.

    bucket: a column that cuts the order into pieces, growing with it. Rows are summed within a key's bucket, the buckets' totals over the key; a window holds the rows of one bucket, or one row a
    bucket. Keys may be null."""
    rows = frame.withColumn("_value", value)
    totals = rows.groupBy(*by, bucket).agg(F.sum("_value").alias("_total"))
    carried = totals.select(*(F.col(c).alias(f"_{c}") for c in [*by, bucket]), F.coalesce(F.sum("_total").over(_earlier(*by).orderBy(bucket)), F.lit(0)).alias("_carried"))
    same = F.lit(True)
    for c in [*by, bucket]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.coalesce(F.sum("_value").over(_earlier(*by, bucket).orderBy(*order)), F.lit(0))
    return rows.withColumn("_inside", inside).join(carried, same).select(*frame.columns, (F.col("_inside") + F.col("_carried")).alias(name))


def last_before(frame: DataFrame, by: list[str], bucket: str, order: list[Column | str], value: Column, name: str = "last") -> DataFrame:
    """frame with the last non-null ``value`` among the earlier rows of its key, null if there is none; by buckets as in ``sum_before``."""
    rows = frame.withColumn("_value", value)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    lasts = rows.groupBy(*by, bucket).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_total"))
    carried = lasts.select(*(F.col(c).alias(f"_{c}") for c in [*by, bucket]), F.last("_total", ignorenulls=True).over(_earlier(*by).orderBy(bucket)).alias("_carried"))
    same = F.lit(True)
    for c in [*by, bucket]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.last("_value", ignorenulls=True).over(_earlier(*by, bucket).orderBy(*order))
    return rows.withColumn("_inside", inside).join(carried, same).select(*frame.columns, F.coalesce("_inside", "_carried").alias(name))
