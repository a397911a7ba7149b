"""Factors as relations: attribute columns and a value ``v``; products are natural joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEGATIVE = float("-inf")


def attributes(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c != "v"]


def _joined(f: DataFrame, g: DataFrame, value: Column) -> DataFrame:
    """The natural join; factors without a shared attribute are small by definition and expand to all
    combinations, as a product of factors must."""
    mine, theirs = attributes(f), attributes(g)
    shared = [a for a in mine if a in theirs]
    left, right = f.withColumnRenamed("v", "_l"), g.withColumnRenamed("v", "_r")
    both = left.join(right, shared) if shared else left.crossJoin(right)
    return both.select(*mine, *(a for a in theirs if a not in mine), value.alias("v"))


def product(f: DataFrame, g: DataFrame) -> DataFrame:
    return _joined(f, g, F.col("_l") * F.col("_r"))


def added(f: DataFrame, g: DataFrame) -> DataFrame:
    """Sum of values, which is the product of factors in log space."""
    return _joined(f, g, F.col("_l") + F.col("_r"))


def subtracted(f: DataFrame, g: DataFrame) -> DataFrame:
    """Difference of log values; minus infinity on the right counts as 0."""
    return _joined(f, g, F.col("_l") - F.when(F.col("_r") == _NEGATIVE, 0.0).otherwise(F.col("_r")))


def divided(f: DataFrame, g: DataFrame) -> DataFrame:
    """Quotient; 0 where the divisor is not positive."""
    return _joined(f, g, F.when(F.col("_r") > 0, F.col("_l") / F.col("_r")).otherwise(0.0))


def log_added(f: DataFrame, g: DataFrame) -> DataFrame:
    """log(exp(l) + exp(r)) without overflow."""
    high, low = F.greatest("_l", "_r"), F.least("_l", "_r")
    return _joined(f, g, F.when(low == _NEGATIVE, high).otherwise(high + F.log1p(F.exp(low - high))))


def summed(f: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Sums the attributes out that are not kept."""
    return f.groupBy(*keep).agg(F.sum("v").alias("v"))


def maximised(f: DataFrame, keep: Sequence[str]) -> DataFrame:
    return f.groupBy(*keep).agg(F.max("v").alias("v"))


def log_summed(f: DataFrame, keep: Sequence[str]) -> DataFrame:
    """log of the sum of exp(v), the largest value taken out first."""
    if keep:
        tops = f.groupBy(*keep).agg(F.max("v").alias("_m"))
        near = f.join(tops, list(keep))
    else:
        near = f.crossJoin(F.broadcast(f.agg(F.max("v").alias("_m"))))  # one row
    return near.groupBy(*keep, "_m").agg(F.sum(F.exp(F.col("v") - F.col("_m"))).alias("_s")).select(*keep, (F.col("_m") + F.log("_s")).alias("v"))


def conditioned(f: DataFrame, evidence: dict[str, int]) -> DataFrame:
    """The factor where the given attributes have the given values, without them."""
    for a, value in evidence.items():
        f = f.where(F.col(a) == value)
    return f.drop(*evidence)


def active(f: DataFrame, zeros: DataFrame) -> DataFrame:
    """Log potentials: minus infinity on the structural zeros, 0 elsewhere."""
    keys = attributes(f)
    marked = zeros.select(*keys).distinct().withColumn("_z", F.lit(True))
    return f.join(marked, keys, "left").select(*keys, F.when(F.col("_z"), _NEGATIVE).otherwise(0.0).alias("v"))
