"""Mappings of cells to groups: tables (cell, group)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.cells import cantor_pair, coordinates
from marginalia.operators.ordered import numbered


def cells_of(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """(cell, c0, c1, ...) of every cell."""
    return spark.range(math.prod(shape)).select(F.col("id").alias("cell"), *coordinates("id", [f"c{k}" for k in range(len(shape))], shape))


def grid(spark: SparkSession, shape: Sequence[int], block: Sequence[int]) -> DataFrame:
    """Blocks of the given shape, numbered in row-major order; the block must divide the shape."""
    if any(n % b for n, b in zip(shape, block)):
        raise ValueError("the block does not divide the shape")
    number: Column = F.lit(0).cast("long")
    for k, (n, b) in enumerate(zip(shape, block)):
        number = number * (n // b) + F.expr(f"c{k} div {b}")
    return cells_of(spark, shape).select("cell", number.alias("group"))


def striped(spark: SparkSession, shape: Sequence[int], dim: int) -> DataFrame:
    """All cells that differ in one dimension only are a group."""
    number: Column = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        number = number if k == dim else number * n + F.col(f"c{k}")
    return cells_of(spark, shape).select("cell", number.alias("group"))


def by_coordinate(spark: SparkSession, shape: Sequence[int], dim: int) -> DataFrame:
    """All cells with the same value in one dimension are a group."""
    return cells_of(spark, shape).select("cell", F.col(f"c{dim}").cast("long").alias("group"))


def uniform(spark: SparkSession, n: int, side: int) -> DataFrame:
    """Square blocks of an n by n grid; the last ones may be smaller."""
    across = -(-n // side)
    return cells_of(spark, (n, n)).select("cell", (F.expr(f"c0 div {side}") * across + F.expr(f"c1 div {side}")).cast("long").alias("group"))


def hilbert(spark: SparkSession, n: int) -> DataFrame:
    """(cell, group): each cell's place on the Hilbert curve of an n by n grid, n a power of 2."""
    x, y, place = F.col("c0").cast("long"), F.col("c1").cast("long"), F.lit(0).cast("long")
    out = cells_of(spark, (n, n)).select("cell", x.alias("x"), y.alias("y"), place.alias("place"))
    side = n // 2
    while side:
        rx, ry = F.when(F.col("x").bitwiseAND(F.lit(side)) > 0, 1).otherwise(0), F.when(F.col("y").bitwiseAND(F.lit(side)) > 0, 1).otherwise(0)
        out = out.withColumns({"_rx": rx, "_ry": ry}).withColumn("place", F.col("place") + side * side * (3 * F.col("_rx")).bitwiseXOR(F.col("_ry")).cast("long"))
        turned = lambda c: F.when((F.col("_ry") == 0) & (F.col("_rx") == 1), n - 1 - F.col(c)).otherwise(F.col(c))
        out = out.withColumns({"_x": turned("x"), "_y": turned("y")})
        out = out.withColumns({"x": F.when(F.col("_ry") == 0, F.col("_y")).otherwise(F.col("_x")), "y": F.when(F.col("_ry") == 0, F.col("_x")).otherwise(F.col("_y"))})
        side //= 2
    return out.select("cell", F.col("place").alias("group"))


def rectangles(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells (cell, c0, c1) to the box (group, low0, high0, low1, high1) that holds them; the boxes are
    the leaves of a plan and few."""
    b = F.broadcast(boxes) if boxes.count() <= 100_000 else boxes
    return cells.join(b, F.col("c0").between(F.col("low0"), F.col("high0")) & F.col("c1").between(F.col("low1"), F.col("high1"))).select("cell", "group")


def by_workload(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with equal columns of the workload matrix (q, cell, val) are a group: a lossless reduction.
    Groups are compared by their whole columns, not by random projections of them."""
    columns = matrix.where("val != 0").groupBy("cell").agg(F.to_json(F.sort_array(F.collect_list(F.struct("q", "val")))).alias("_sig"))
    signed = cells.select("cell").join(columns, "cell", "left").withColumn("_sig", F.coalesce("_sig", F.lit("")))
    first = signed.groupBy("_sig").agg(F.min("cell").alias("_first"))
    return canonical(signed.join(first, "_sig").select("cell", F.col("_first").alias("group")))


def canonical(mapping: DataFrame) -> DataFrame:
    """Groups renumbered 0, 1, ... in the order in which cells first show them."""
    first = mapping.groupBy("group").agg(F.min("cell").alias("_f"))
    return mapping.join(numbered(first, ["_f"], "_new").select("group", "_new"), "group").select("cell", F.col("_new").alias("group"))


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two partitions of the same cells, numbered canonically."""
    both = a.withColumnRenamed("group", "_a").join(b.withColumnRenamed("group", "_b"), "cell")
    return canonical(both.select("cell", cantor_pair(F.col("_a"), F.col("_b")).alias("group")))


def reduce_by(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(group, cnt): counts summed by group."""
    return counts.join(mapping, "cell").groupBy("group").agg(F.sum("cnt").alias("cnt"))


def expand_by(sums: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cell, cnt): each group's total spread evenly over its cells."""
    sizes = mapping.groupBy("group").agg(F.count("*").alias("_n"))
    return mapping.join(sums.join(sizes, "group"), "group").select("cell", (F.col("cnt") / F.col("_n")).alias("cnt"))


def split_by(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(group, place, cnt): the counts of each group as a line of their own."""
    return counts.join(mapping, "cell").select("group", (F.row_number().over(Window.partitionBy("group").orderBy("cell")) - 1).cast("long").alias("place"), "cnt")


def bounding_boxes(mapping: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(group, low0, high0, low1, high1, rectangular) of each group of a 2D partition."""
    c0, c1 = coordinates("cell", ["c0", "c1"], shape)
    boxes = mapping.select("group", c0, c1).groupBy("group").agg(F.min("c0").alias("low0"), F.max("c0").alias("high0"), F.min("c1").alias("low1"), F.max("c1").alias("high1"), F.count("*").alias("_n"))
    return boxes.select("group", "low0", "high0", "low1", "high1", ((F.col("high0") - F.col("low0") + 1) * (F.col("high1") - F.col("low1") + 1) == F.col("_n")).alias("rectangular"))


def complement_intervals(matrix: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """(cell, group): cells that no query touches, in intervals of ``width`` of them."""
    free = cells.select("cell").join(matrix.where("val != 0").select("cell").distinct(), "cell", "left_anti")
    return numbered(free, ["cell"], "_k").select("cell", F.expr(f"_k div {width}").alias("group"))
