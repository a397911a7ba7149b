"""Answers to workloads: contingency tables of many attribute subsets at once.

There are two ways to the same rows (query_id, cell, cnt), with cell the row-major index. ``grouping_sets``
is one GROUPING SETS plan for every CHUNK queries: Spark expands and hashes each row once per query.
``dense`` counts whole Arrow batches into arrays, one per query, in the tasks, and sums the tasks' counts;
it is faster by an order of magnitude where the arrays are small. ``marginals`` takes the second way if all
cells of a workload, times groups, fit in a task's memory, else the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import cell
from marginalia.operators.workload import Query

CHUNK = 31  # queries of one grouping-set plan
DENSE_CELLS = 4_000_000  # 8 bytes each in every task
ROWS = 1 << 16  # counted at once


def name(query: Query) -> str:
    return ",".join(query)


def counted_rows(df: DataFrame, domain: Domain, keep: Sequence[str] = ()) -> DataFrame:
    """Rows inside the domain: the last bin of an attribute is closed, all outside vanish, nulls too."""
    attrs = [a for a in domain.attrs if a not in keep]
    inside = F.lit(True)
    for a in attrs:
        inside = inside & F.col(a).between(0, domain[a])
    # least() rather than a comparison, so that an attribute's expression is repeated as little as can be
    return df.where(inside).select(*keep, *(F.least(F.col(a), F.lit(domain[a] - 1)).cast("int").alias(a) for a in attrs))


def datavector(df: DataFrame, domain: Domain, query: Query, weight: str | None = None) -> DataFrame:
    """(cell, cnt) of one query, cells without rows left out; weights are summed if given."""
    part = domain.project(query)
    rows = counted_rows(df, part, [weight] if weight else [])
    total = F.sum(weight) if weight else F.count("*")
    return rows.groupBy(cell(part.attrs, part.shape).alias("cell")).agg(total.alias("cnt"))


def grouping_sets(df: DataFrame, domain: Domain, workload: Sequence[Query], by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """(by..., query_id, cell, cnt) by GROUPING SETS, a plan for every ``chunk`` queries."""
    out = None
    for k in range(0, len(workload), chunk):
        part = workload[k : k + chunk]
        used = domain.project(domain.canonical({a for q in part for a in q}))
        rows = counted_rows(df, used, by)
        grouped = rows.groupingSets([[F.col(c) for c in (*by, *q)] for q in part], *by, *used.attrs).agg(F.grouping_id().alias("_gid"), F.count("*").alias("cnt"))
        # grouping_id() has a bit per column, the first highest, set where the column is not in the set
        width = len(by) + len(used)
        label, place = F.lit(None).cast("string"), F.lit(None).cast("long")
        for q in part:
            gid = sum(1 << (width - 1 - len(by) - i) for i, a in enumerate(used.attrs) if a not in q)
            label = F.when(F.col("_gid") == gid, name(q)).otherwise(label)
            own = domain.project(q)
            place = F.when(F.col("_gid") == gid, cell(own.attrs, own.shape)).otherwise(place)
        made = grouped.select(*by, label.alias("query_id"), place.alias("cell"), "cnt")
        out = made if out is None else out.unionByName(made)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of ROWS rows or a few more, however small the session's batches are."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _columns(held)
            held, n = [], 0
    if n:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy().astype(np.int64) for c in table.column_names}


def dense(df: DataFrame, domain: Domain, workload: Sequence[Query], by: str | None = None, groups: int = 1) -> DataFrame:
    """(by, query_id, cell, cnt) by counting Arrow batches; ``by`` holds 0 to groups - 1."""
    used = domain.project(domain.canonical({a for q in workload for a in q}))
    rows = counted_rows(df, used, [by] if by else [])
    parts = [domain.project(q) for q in workload]
    sizes = [p.size() for p in parts]
    starts = np.cumsum([0, *sizes])
    whole = int(starts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(whole * groups, dtype=np.int64)
        for columns in _gathered(batches):
            base = columns[by] * whole if by else None
            for part, start, size in zip(parts, starts, sizes):
                at = columns[part.attrs[0]]
                for a, n in zip(part.attrs[1:], part.shape[1:]):
                    at = at * n + columns[a]
                if base is None:
                    total[start : start + size] += np.bincount(at, minlength=size)
                else:
                    np.add.at(total, base + start + at, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "cnt"])

    summed = rows.mapInArrow(run, "at bigint, cnt bigint").groupBy("at").agg(F.sum("cnt").alias("cnt"))
    inner = F.col("at") % whole
    edges = F.array(*(F.lit(int(s)) for s in starts[:-1]))
    names = F.array(*(F.lit(name(q)) for q in workload))
    which = F.size(F.filter(edges, lambda e: e <= inner))
    placed = summed.select(*([F.expr(f"at div {whole}L").cast("int").alias(by)] if by else []), which.alias("_w"), inner.alias("_inner"), "cnt")
    return placed.select(*([by] if by else []), F.element_at(names, F.col("_w")).alias("query_id"), (F.col("_inner") - F.element_at(edges, F.col("_w"))).cast("long").alias("cell"), "cnt")


def marginals(df: DataFrame, domain: Domain, workload: Sequence[Query], by: str | None = None, groups: int = 1) -> DataFrame:
    """All answers, by the way that fits: see the module."""
    cells = sum(domain.size(q) for q in workload) * groups
    if cells <= DENSE_CELLS and (by is None or groups > 1):
        return dense(df, domain, workload, by, groups)
    return grouping_sets(df, domain, workload, [by] if by else [])


def all_cells(spark, domain: Domain, workload: Sequence[Query]) -> DataFrame:
    """(query_id, cell) of every cell of every query, rows made in the cluster."""
    sizes = spark.createDataFrame([(name(q), domain.size(q)) for q in workload], "query_id string, n bigint")
    return sizes.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("cell"))


def zero_filled(counts: DataFrame, domain: Domain, workload: Sequence[Query]) -> DataFrame:
    """(query_id, cell, cnt) for every cell, 0 where there are no rows. Noise must go to all of them."""
    cells = all_cells(counts.sparkSession, domain, workload)
    return cells.join(counts, ["query_id", "cell"], "left").select("query_id", "cell", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def statistics(counts: DataFrame, cells: int) -> DataFrame:
    """(total, largest, nonzero_share) of a histogram of ``cells`` cells, given those with rows."""
    return counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.max("cnt"), F.lit(0)).alias("largest"), (F.sum(F.when(F.col("cnt") > 0, 1).otherwise(0)) / cells).alias("nonzero_share"))


def summed_over(counts: DataFrame) -> DataFrame:
    """Clients' answers summed to one."""
    return counts.groupBy("query_id", "cell").agg(F.sum("cnt").alias("cnt"))


def normalised(counts: DataFrame, to: float = 1.0) -> DataFrame:
    """Counts scaled so that each query sums to ``to``; a query without counts stays as it is."""
    totals = counts.groupBy("query_id").agg(F.sum("cnt").alias("_total"))
    return counts.join(totals, "query_id").withColumn("cnt", F.when(F.col("_total") > 0, to * F.col("cnt") / F.col("_total")).otherwise(F.col("cnt").cast("double"))).drop("_total")


def batched(counts: DataFrame) -> DataFrame:
    """(query_id, y): each query's answer as one array in the order of cells; queries are of bounded
    size by the choice of the workload."""
    return counts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "cnt"))), lambda s: s["cnt"].cast("double")).alias("y"))
