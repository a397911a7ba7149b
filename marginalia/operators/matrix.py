"""Query matrices as tables (q, cell, val) of their non-zero entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("q"), F.col("id").alias("cell"), F.lit(1.0).alias("val"))


def ones(spark, rows: int, n: int) -> DataFrame:
    return spark.range(rows * n).select(F.expr(f"id div {n}").alias("q"), (F.col("id") % n).alias("cell"), F.lit(1.0).alias("val"))


def total(spark, n: int) -> DataFrame:
    return ones(spark, 1, n)


def prefix(spark, n: int) -> DataFrame:
    """Lower triangle of ones; kept implicit by ranges.prefix_sums where n is large."""
    return spark.range(n).select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("cell"), F.lit(1.0).alias("val"))


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """(q, y): the matrix times the vector (cell, x)."""
    return a.join(x, "cell").groupBy("q").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("cell").alias("q"), F.col("q").alias("cell"), "val")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: entries meet on a's cell and b's row."""
    right = b.select(F.col("q").alias("_k"), F.col("cell").alias("_c"), F.col("val").alias("_v"))
    return a.join(right, F.col("cell") == F.col("_k")).groupBy("q", F.col("_c").alias("cell")).agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


def gram(a: DataFrame) -> DataFrame:
    return matmul(transpose(a), a)


def sensitivity_l1(a: DataFrame) -> DataFrame:
    """One row: the largest sum of absolute values of a column."""
    return a.groupBy("cell").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s").alias("sensitivity"))


def weighted(a: DataFrame, weight: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * weight)


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("q", "cell").agg(F.sum("val").alias("val"))


def vstack(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices, each with its number of rows, one above the other."""
    out, at = None, 0
    for a, rows in parts:
        moved = a.withColumn("q", F.col("q") + at)
        out, at = moved if out is None else out.unionByName(moved), at + rows
    return out


def hstack(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    return transpose(vstack([(transpose(a), columns) for a, columns in parts]))


def kronecker(a: DataFrame, b: DataFrame, b_rows: int, b_columns: int) -> DataFrame:
    """All products of entries, which is what a Kronecker product is; see multiply_kronecker for the
    product with a vector, which never forms it."""
    right = b.select(F.col("q").alias("_q"), F.col("cell").alias("_c"), F.col("val").alias("_v"))
    return a.crossJoin(right).select((F.col("q") * b_rows + F.col("_q")).alias("q"), (F.col("cell") * b_columns + F.col("_c")).alias("cell"), (F.col("val") * F.col("_v")).alias("val"))


def multiply_kronecker(a: DataFrame, b: DataFrame, x: DataFrame, b_rows: int, b_columns: int) -> DataFrame:
    """(q, y) of the Kronecker product times (cell, x), one side after the other."""
    placed = x.select(F.expr(f"cell div {b_columns}").alias("_i"), (F.col("cell") % b_columns).alias("cell"), "x")
    inner = b.join(placed, "cell").groupBy("_i", "q").agg(F.sum(F.col("val") * F.col("x")).alias("_y"))
    left = a.select(F.col("q").alias("_q"), F.col("cell").alias("_i"), "val")
    return left.join(inner, "_i").groupBy((F.col("_q") * b_rows + F.col("q")).alias("q")).agg(F.sum(F.col("val") * F.col("_y")).alias("y"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("q = cell").agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("trace"))


def reduction(mapping: DataFrame) -> DataFrame:
    """(cell, group) as the matrix that sums each group."""
    return mapping.select(F.col("group").alias("q"), "cell", F.lit(1.0).alias("val"))


def expansion(mapping: DataFrame) -> DataFrame:
    """The matrix that spreads a group's total evenly over its cells."""
    return mapping.select(F.col("cell").alias("q"), F.col("group").alias("cell"), (1.0 / F.count("*").over(Window.partitionBy("group"))).alias("val"))
