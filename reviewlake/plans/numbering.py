"""Positions in a global order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.plans.storage import stored


def starts(sizes: DataFrame, by: str, size: str) -> DataFrame:
    """sizes(by, size), a row a key, with start: the sum of size over all keys
    before.  Keys are dealt over ranges; each is summed by itself, and their
    totals (a row a range) are broadcast."""
    ranged = stored(sizes.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_total")).select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return placed.join(F.broadcast(totals), "_range").select(*sizes.columns, (F.col("_skip") + F.col("_own")).alias("start"))
