"""Workloads: sets of attribute subsets, each a query for a contingency table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = tuple[str, ...]


def k_way(attrs: Sequence[str], k: int) -> list[Query]:
    """All subsets of ``k`` attributes, in the attributes' order."""
    return list(combinations(attrs, k))


def k_way_target(attrs: Sequence[str], target: str, k: int) -> list[Query]:
    """All subsets of ``k`` attributes that hold the target, which stands last."""
    return [(*q, target) for q in combinations([a for a in attrs if a != target], k - 1)]


def some_way(attrs: Sequence[str], sizes: Iterable[int]) -> list[Query]:
    """Subsets of any of the given sizes."""
    return [q for k in sizes for q in combinations(attrs, k)]


def subsample(workload: Sequence[Query], number: int | None, seed: int) -> list[Query]:
    """``number`` queries without replacement, by a hash of seed and query; all if there are fewer."""
    if number is None or number >= len(workload):
        return list(workload)
    by_hash = sorted(workload, key=lambda q: hashlib.md5(f"{seed}|{','.join(q)}".encode()).hexdigest())
    kept = set(by_hash[:number])
    return [q for q in workload if q in kept]


def closure(workload: Iterable[Query]) -> list[Query]:
    """Every non-empty subset of every query, once, small ones first."""
    found = {s for q in workload for k in range(1, len(q) + 1) for s in combinations(q, k)}
    return sorted(found, key=lambda q: (len(q), q))


def complement(attrs: Sequence[str], workload: Iterable[Query], k: int) -> list[Query]:
    """Subsets of size ``k`` that are not in the workload."""
    known = {frozenset(q) for q in workload}
    return [q for q in combinations(attrs, k) if frozenset(q) not in known]


def scores(workload: Sequence[Query], of: Iterable[Query] | None = None) -> dict[Query, int]:
    """How many attributes each query shares with the queries of the workload, summed."""
    return {q: sum(len(set(q) & set(w)) for w in workload) for q in (closure(workload) if of is None else of)}


def for_target(workload: Iterable[Query], target: str) -> list[Query]:
    """Queries that hold the target or have one attribute."""
    return [q for q in workload if target in q or len(q) == 1]


def as_frame(spark: SparkSession, workload: Sequence[Query]) -> DataFrame:
    """(query_id, attrs): the workload as a table."""
    return spark.createDataFrame([(",".join(q), list(q)) for q in workload], "query_id string, attrs array<string>")


def score_frame(workload: DataFrame, of: DataFrame) -> DataFrame:
    """(query_id, score) for each query of ``of``; both tables are as small as a workload."""
    w = F.broadcast(workload.select(F.col("attrs").alias("_w")))
    return of.crossJoin(w).groupBy("query_id").agg(F.sum(F.size(F.array_intersect("attrs", "_w"))).cast("long").alias("score"))


def bitmask(attrs: Sequence[str], query: Query) -> int:
    """The query as bits, the first attribute lowest."""
    return sum(1 << k for k, a in enumerate(attrs) if a in query)


def from_bitmask(attrs: Sequence[str], mask: int) -> Query:
    return tuple(a for k, a in enumerate(attrs) if mask >> k & 1)
