"""Set operations over tables, workloads and measurements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, as of clients' generators."""
    if any(set(p.columns) != set(parts[0].columns) for p in parts):
        raise ValueError("tables with different columns")
    return reduce(lambda a, b: a.unionByName(b), parts)


def intersections(cliques: DataFrame) -> DataFrame:
    """The family (attrs array, sorted) closed under pairwise intersection; as small as a model, so the
    fixed point is found by joining the family with itself."""
    now = cliques.select(F.sort_array("attrs").alias("attrs")).distinct()
    n = now.count()
    while True:
        a, b = now.select(F.col("attrs").alias("_a")), F.broadcast(now.select(F.col("attrs").alias("_b")))
        met = a.crossJoin(b).select(F.sort_array(F.array_intersect("_a", "_b")).alias("attrs")).where(F.size("attrs") > 0)
        now = now.union(met).distinct().persist()
        m = now.count()
        if m == n:
            return now
        n = m


def disjunct(q: DataFrame, r: DataFrame) -> DataFrame:
    """(row, cell, val) of the union of pairs of 0/1 predicates over two attributes: 1 - (1 - q)(1 - r),
    given (q, x, val) and (r, y, val) for all x and y."""
    left, right = q.select("q", "x", F.col("val").alias("_l")), r.select("r", "y", F.col("val").alias("_r"))
    return left.crossJoin(F.broadcast(right)).select("q", "r", "x", "y", (1 - (1 - F.col("_l")) * (1 - F.col("_r"))).alias("val"))


def complement_queries(all_queries: DataFrame, known: DataFrame) -> DataFrame:
    return all_queries.join(known.select("query_id").distinct(), "query_id", "left_anti")
