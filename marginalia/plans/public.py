"""Public rows made to fit private answers: weights on public rows by entropic mirror descent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import cell
from marginalia.plans.pgm import Measurement, estimate_total


def reweighted(public: DataFrame, domain: Domain, measurements: Sequence[Measurement], iterations: int = 100, rate: float | None = None) -> DataFrame:
    """Adds ``weight`` to the public rows, so that their weighted marginals fit the measurements.

    Rows that agree on all measured attributes get equal weights, so they are counted once and stay in
    Spark. The log weight of a row is a sum of potentials of its cells, so the state of the descent is as
    small as the measurements, and a step is one weighted sum per measured query."""
    attrs = domain.canonical({a for m in measurements for a in m.query})
    total = estimate_total(measurements)
    kinds = public.select(*attrs).groupBy(*attrs).agg(F.count("*").alias("_n"))
    rate = rate if rate is not None else 1.0 / total
    names = [f"_c{k}" for k in range(len(measurements))]
    placed = kinds.withColumns({c: cell(m.query, domain.project(m.query).shape) for c, m in zip(names, measurements)}).persist()
    potentials = [np.zeros(m.y.size) for m in measurements]
    best, kept = np.inf, [p.copy() for p in potentials]
    for _ in range(iterations):
        # a row's log weight is the sum of its cells' potentials, so the state is as small as these
        tables = [F.array(*(F.lit(float(v)) for v in p)) for p in potentials]
        score = sum((F.element_at(t, (F.col(c) + 1).cast("int")) for t, c in zip(tables, names)), F.lit(0.0))
        weighted = placed.withColumn("_w", F.col("_n") * F.exp(score))
        parts = weighted.select("_w", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("cell")) for k, c in enumerate(names)))).alias("s")).groupBy("s.k", "s.cell").agg(F.sum("_w").alias("w")).collect()
        sums = [np.zeros(m.y.size) for m in measurements]
        for r in parts:
            sums[r.k][r.cell] = r.w
        scale = total / sums[0].sum()
        loss, steps = 0.0, []
        for m, x in zip(measurements, sums):
            d = (x * scale - m.y) / m.sigma
            loss += 0.5 * float(d @ d)
            steps.append(d / m.sigma)
        if loss < best:
            best, kept = loss, [p.copy() for p in potentials]
            rate *= 1.1
        else:
            potentials = [p.copy() for p in kept]
            rate *= 0.5
            if rate < 1e-12 / total:
                break
            continue
        potentials = [p - rate * g for p, g in zip(potentials, steps)]
    tables = [F.array(*(F.lit(float(v)) for v in p)) for p in kept]
    score = sum((F.element_at(t, (cell(m.query, domain.project(m.query).shape) + 1).cast("int")) for t, m in zip(tables, measurements)), F.lit(0.0))
    raw = public.withColumn("_w", F.exp(score))
    whole = F.broadcast(raw.agg(F.sum("_w").alias("_all")))  # one row
    out = raw.crossJoin(whole).withColumn("weight", F.col("_w") * total / F.col("_all")).drop("_w", "_all")
    placed.unpersist()
    return out
