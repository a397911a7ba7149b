"""Orders over all rows: numbers and running values without bringing all rows together.

Rows are dealt into ranges of the order and written with their range's number. (Ranges follow from samples,
so a plan that dealt rows twice could number them by two different sets of ranges; writing fixes one.) What
comes before a range follows from one row per range, and only those rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.storage import written

Order = Sequence[Column | str]


def in_ranges(df: DataFrame, order: Order) -> DataFrame:
    """The rows with ``_range``, a number that rises with the order. Rows that are equal in the order
    share a range."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _before(ranged: DataFrame, total: Column, combine, empty) -> DataFrame:
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(total.alias("_t"))
    return F.broadcast(sums.select("_range", F.coalesce(combine("_t").over(w), F.lit(empty)).alias("_b")))  # a row per range


def numbered(df: DataFrame, order: Order, name: str) -> DataFrame:
    """Adds 0, 1, ... in the order, which must tell all rows apart but equal ones."""
    ranged = in_ranges(df, order)
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    out = own.join(_before(ranged, F.count("*"), F.sum, 0), "_range")
    return out.select(*df.columns, (F.col("_own") + F.col("_b")).cast("long").alias(name))


def running_sum(df: DataFrame, order: Order, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row."""
    ranged = in_ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_own", F.sum(value).over(inside)).join(_before(ranged, F.sum(value), F.sum, 0), "_range")
    return out.select(*df.columns, (F.col("_own") + F.col("_b")).alias(name))


def running_max(df: DataFrame, order: Order, value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` up to each row; null before the first."""
    ranged = in_ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_own", F.max(value).over(inside)).join(_before(ranged, F.max(value), F.max, None), "_range")
    return out.select(*df.columns, F.coalesce("_own", "_b").alias(name))
