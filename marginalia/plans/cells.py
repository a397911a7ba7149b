"""Histograms from noisy linear answers over tables of cells, in rounds of joins and sums.

Operators are those of operators.implicit; vectors are tables (i, v). Every round writes its tables to the
shared folder; norms and step sizes are all that reaches the driver. plans.inference has the same for
histograms that fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import cell, coordinates
from marginalia.operators.implicit import Identity, Kronecker, Operator, Stack, Total, Weighted, ones
from marginalia.storage import written

#: An operator, its answers (i, v), and the deviation of their noise.
Part = tuple[Operator, DataFrame, float]


def stacked(parts: Sequence[Part]) -> tuple[Operator, DataFrame]:
    """All measurements as one, each over its deviation."""
    a = Stack([Weighted(op, 1 / sigma) for op, _, sigma in parts])
    y = None
    for start, (_, own, sigma) in zip(a.starts, parts):
        own = own.select((F.col("i") + start).alias("i"), (F.col("v") / sigma).alias("v"))
        y = own if y is None else y.unionByName(own)
    return a, y


def _total(df: DataFrame, value: Column) -> float:
    return float(df.agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0])


def least_squares(parts: Sequence[Part], rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(i, v) that fits all answers best, each weighted by its noise; the smallest such, if several do.

    Conjugate gradients on the normal equations, which are never formed: a round takes one product with the
    operator and one with its adjoint, and as many rounds are needed as there are different singular values, few
    for hierarchies. It ends when the gradient's norm is ``tolerance`` of what it was at first, or is
    no longer getting smaller for want of digits."""
    a, y = stacked(parts)
    residual = written(y.select("i", F.col("v").alias("r")), "residual")
    gradient = a.adjoint(residual.select("i", F.col("r").alias("v")))
    state = written(gradient.select("i", F.lit(0.0).alias("x"), F.col("v").alias("s"), F.col("v").alias("p")), "state")
    first = size = _total(state, F.col("s") ** 2)
    for _ in range(rounds):
        if size <= tolerance**2 * first:
            break
        image = a.apply(state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        both = written(residual.join(image, "i"), "residual")
        step = size / _total(both, F.col("q") ** 2)
        residual = both.select("i", (F.col("r") - step * F.col("q")).alias("r"))
        gradient = a.adjoint(residual.select("i", F.col("r").alias("v")))
        moved = state.join(gradient.withColumnRenamed("v", "g"), "i")
        after = written(moved.select("i", (F.col("x") + step * F.col("p")).alias("x"), F.col("g").alias("s"), "p"), "state")
        was, size = size, _total(after, F.col("s") ** 2)
        if size > was and size <= 1e-16 * first:
            return after.select("i", F.col("x").alias("v"))
        state = after.select("i", "x", "s", (F.col("s") + size / was * F.col("p")).alias("p"))
    return state.select("i", F.col("x").alias("v"))


def _largest(a: Operator, spark) -> float:
    """No less than the square of the operator's norm: the largest sum of a column times that of a row."""
    absolute = a.absolute()
    row = absolute.apply(ones(spark, a.columns)).agg(F.max("v")).first()[0]
    return float(row) * float(absolute.adjoint(ones(spark, a.rows)).agg(F.max("v")).first()[0])


def non_negative(parts: Sequence[Part], start: DataFrame | None = None, rounds: int = 200, tolerance: float = 1e-8, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """(i, v) with v >= 0 that fits best, by projected gradients with momentum (Nesterov's, started again when it
    points uphill). It begins at ``start``, or the least-squares fit, cut off at 0, and ends when no cell moves by
    more than ``tolerance`` of the largest."""
    a, y = stacked(parts)
    y = written(y, "answers")
    step = 1 / (_largest(a, y.sparkSession) + l2)
    begin = least_squares(parts) if start is None else start
    state = written(begin.select("i", F.greatest("v", F.lit(0.0)).alias("x")).withColumn("z", F.col("x")), "state")
    t = 1.0
    for _ in range(rounds):
        image = a.apply(state.select("i", F.col("z").alias("v"))).withColumnRenamed("v", "q")
        wrong = written(y.join(image, "i").select("i", (F.col("q") - F.col("v")).alias("v")), "wrong")
        moved = state.join(a.adjoint(wrong).withColumnRenamed("v", "g"), "i").withColumn("g", F.col("g") + l1 + l2 * F.col("z"))
        after = written(moved.withColumn("to", F.greatest(F.col("z") - step * F.col("g"), F.lit(0.0))).select("i", "x", "g", "to"), "state")
        uphill, change, top = after.agg(F.sum(F.col("g") * (F.col("to") - F.col("x"))), F.max(F.abs(F.col("to") - F.col("x"))), F.max("to")).first()
        t = 1.0 if uphill > 0 else t
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        state = after.select("i", F.col("to").alias("x"), (F.col("to") + (t - 1) / t2 * (F.col("to") - F.col("x"))).alias("z"))
        t = t2
        if change <= tolerance * max(1.0, top):
            break
    return state.select("i", F.col("x").alias("v"))


def workload_non_negative(workload: Operator, parts: Sequence[Part], **how) -> DataFrame:
    """Non-negative cells whose answers to ``workload`` are nearest to those of the least-squares fit."""
    fit = written(least_squares(parts), "fit")
    return non_negative([(workload, written(workload.apply(fit), "answers"), 1.0)], start=fit, **how)


def multiplicative_weights(parts: Sequence[tuple[Operator, DataFrame]], x: DataFrame, rounds: int = 50) -> DataFrame:
    """Updates cells (i, v), their total kept, towards all answers at once in each round: each cell times
    exp(adjoint of what the answers lack / (2 total))."""
    a, y = stacked([(op, own, 1.0) for op, own in parts])
    y = written(y, "answers")
    x = written(x.select("i", "v"), "weights")
    total = _total(x, F.col("v"))
    for _ in range(rounds):
        lack = y.join(a.apply(x).withColumnRenamed("v", "q"), "i").select("i", (F.col("v") - F.col("q")).alias("v"))
        push = a.adjoint(written(lack, "lack")).withColumnRenamed("v", "u")
        moved = written(x.join(push, "i").select("i", (F.col("v") * F.exp(F.col("u") / (2 * total))).alias("v")), "weights")
        x = moved.withColumn("v", F.col("v") * (total / _total(moved, F.col("v"))))
    return x


class FactoredWeights:
    """Multiplicative weights over a domain too large to list: attributes that no measured query connects are
    independent, so every group of connected ones has a table of its own. ``measured`` has a query and its answers (i, v),
    cells in the order of the query's attributes."""

    def __init__(self, domain: Domain, measured: Sequence[tuple[Sequence[str], DataFrame]], total: float, rounds: int = 50):
        self.domain, self.total = domain, float(total)
        groups: list[set[str]] = []
        for query, _ in measured:
            touched = [g for g in groups if g & set(query)]
            groups = [g for g in groups if g not in touched] + [set(query).union(*touched)]
        self.groups = [domain.canonical(g) for g in groups]
        self.tables = {}
        for g in self.groups:
            parts = [(self.marginal(g, q), self._ordered(q, y)) for q, y in measured if set(q) <= set(g)]
            size = domain.size(g)
            even = ones(parts[0][1].sparkSession, size).withColumn("v", F.lit(self.total / size))
            self.tables[g] = multiplicative_weights(parts, even, rounds)

    def marginal(self, group: Sequence[str], query: Sequence[str]) -> Operator:
        """The marginal on the attributes of ``query``, in the group's order, as an operator on the group's cells."""
        return Kronecker([Identity(self.domain[a]) if a in query else Total(self.domain[a]) for a in group])

    def _ordered(self, query: Sequence[str], y: DataFrame) -> DataFrame:
        """Answers with cells in the domain's order of attributes."""
        own = self.domain.canonical(query)
        at = y.select("v", *coordinates("i", list(query), self.domain.project(query).shape))
        return at.select(cell(own, self.domain.project(own).shape).alias("i"), "v")

    def answer(self, query: Sequence[str]) -> DataFrame:
        """(i, v): the marginal on any attributes, as the product of those of the groups; attributes without a group
        are even."""
        query = tuple(query)
        spark = next(iter(self.tables.values())).sparkSession
        parts = []
        for g in self.groups:
            if own := tuple(a for a in g if a in query):
                found = self.marginal(g, own).apply(self.tables[g])
                parts.append(found.select(*coordinates("i", list(own), self.domain.project(own).shape), F.col("v").alias(f"_v{len(parts)}")))
        for a in query:
            if not any(a in g for g in self.groups):
                parts.append(spark.range(self.domain[a]).select(F.col("id").cast("int").alias(a), F.lit(self.total / self.domain[a]).alias(f"_v{len(parts)}")))
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)  # the cells of the query, which is what is asked for
        value = F.lit(self.total)
        for k in range(len(parts)):
            value = value * (F.col(f"_v{k}") / self.total)
        return out.select(cell(query, self.domain.project(query).shape).alias("i"), value.alias("v"))
