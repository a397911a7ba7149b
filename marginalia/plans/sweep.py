"""Sweeps: grids of parameters as tables of tasks."""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, params: dict[str, list[Any]]) -> DataFrame:
    """One row per combination of the parameters' values, with ``task_id``, a hash of them."""
    rows = list(product(*params.values()))
    frame = spark.createDataFrame(rows, list(params))
    return frame.withColumn("task_id", F.md5(F.to_json(F.struct(*params))))


def remaining(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(results.select("task_id").distinct(), "task_id", "left_anti")


def slice_of(tasks: DataFrame, rank: int, ranks: int) -> DataFrame:
    """A rank's part of the tasks, by their hash."""
    return tasks.where(F.pmod(F.xxhash64("task_id"), F.lit(ranks)) == rank)


def flattened(config: dict, prefix: str = "", sign: str = ".") -> dict:
    """Nested settings with dotted names."""
    out = {}
    for k, v in config.items():
        name = f"{prefix}{sign}{k}" if prefix else k
        out |= flattened(v, name, sign) if isinstance(v, dict) else {name: v}
    return out


def merged_results(spark: SparkSession, folder: str) -> DataFrame:
    """All result files of a folder, columns by name; those of merged files are left out."""
    files = spark.read.option("header", True).option("inferSchema", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
    return files.where(~F.input_file_name().contains("full"))
