"""An adaptive grid: marginals measured level by level, each cell by itself where its parts have counts, together
with others elsewhere.

The grid of a set of attributes has a row for every cell that is plausible, that is, whose cells on all
subsets of one attribute less have been measured at ``least`` or more. All other cells are measured through
the grids of those subsets: each of their rows, restricted to what is not plausible, with a weight of one over the
root of the number of subsets, so that a row of the data changes a measurement by 1 at most. Grids are
tables: rows are (part, cell), the path of subsets to the grid that the row comes from and a cell there. Counts
of rows are sums over the occupied cells alone; only plausible rows are ever listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import cell, coordinates
from marginalia.functions.rng import keyed_normal
from marginalia.operators import marginals, workload
from marginalia.operators.workload import Query
from marginalia.plans import accounting
from marginalia.plans.mechanisms import Result, _choose, answers
from marginalia.plans.pgm import Measurement, estimate
from marginalia.storage import written

_PATH = ">"


@dataclass
class Grids:
    """The grids measured so far, by attributes."""

    spark: SparkSession
    domain: Domain
    listed: dict[Query, DataFrame] = field(default_factory=dict)  # rows (part, cell, weight) in all
    own: dict[Query, DataFrame] = field(default_factory=dict)  # plausible cells (attrs...), which have rows of their own
    high: dict[Query, DataFrame] = field(default_factory=dict)  # those of them that were measured at ``least`` or more

    def _below(self, query: Query, among: dict[Query, DataFrame]) -> list[Query]:
        return [c for c in combinations(query, len(query) - 1) if c in among]

    def candidates(self, query: Query) -> DataFrame:
        """The plausible cells of ``query``: the natural join of what is high on its subsets, and every value of
        attributes that none of these has."""
        found = None
        for c in self._below(query, self.high):
            found = self.high[c] if found is None else self._met(found, self.high[c])
        for a in query:
            if found is None or a not in found.columns:
                values = self.spark.range(self.domain[a]).select(F.col("id").cast("int").alias(a))
                found = values if found is None else found.crossJoin(values)  # the cells of the grid, as many as are listed
        return found.select(*query)

    @staticmethod
    def _met(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)  # subsets of one attribute each: their cells are the grid

    def rows(self, counts: DataFrame, query: Query) -> DataFrame:
        """(part, cell, v): what the counts (attrs..., cnt) of cells add to the rows of the grid of ``query``."""
        shape = self.domain.project(query).shape
        flagged = counts.join(self.own[query].withColumn("_own", F.lit(True)), list(query), "left")
        out = flagged.where("_own").select(F.lit("").alias("part"), cell(query, shape).alias("cell"), F.col("cnt").cast("double").alias("v"))
        below = self._below(query, self.listed)
        rest = flagged.where("_own IS NULL")
        for c in below:
            inside = self.rows(rest.groupBy(*c).agg(F.sum("cnt").alias("cnt")), c)
            out = out.unionByName(inside.select(self._path(c).alias("part"), "cell", (F.col("v") / math.sqrt(len(below))).alias("v")))
        return out.groupBy("part", "cell").agg(F.sum("v").alias("v"))

    def _path(self, c: Query):
        return F.concat_ws(_PATH, F.lit(",".join(c)), F.when(F.col("part") != "", F.col("part")))

    def measure(self, counts: DataFrame, query: Query, sigma: float, least: float, seed: str | int) -> DataFrame:
        """(part, cell, v): the rows of the grid of ``query``, measured with normal noise; the grid is then there
        for larger sets. ``counts`` has (attrs..., cnt) of the occupied cells."""
        shape = self.domain.project(query).shape
        self.own[query] = own = written(self.candidates(query), "plausible")
        every = own.select(F.lit("").alias("part"), cell(query, shape).alias("cell"))
        for c in self._below(query, self.listed):
            every = every.unionByName(self.listed[c].select(self._path(c).alias("part"), "cell"))
        every = written(every, "grid")
        noise = sigma * keyed_normal(seed, F.lit(",".join(query)), "part", "cell") if sigma else F.lit(0.0)
        found = written(every.join(self.rows(counts, query), ["part", "cell"], "left").select("part", "cell", (F.coalesce("v", F.lit(0.0)) + noise).alias("v")), "measured")
        self.listed[query] = every
        self.high[query] = found.where((F.col("part") == "") & (F.col("v") >= least)).select(*coordinates("cell", list(query), shape))
        return found

    def matrix(self, query: Query, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a measured grid as a matrix over the cells of ``query``, and their answers; for domains of a
        model on the driver, whose limit bounds the cells."""
        shape = self.domain.project(query).shape
        table = found.orderBy("part", "cell").toArrow()  # no more rows than the grids of the subsets have cells
        place = {key: k for k, key in enumerate(zip(table.column("part").to_pylist(), table.column("cell").to_pylist()))}
        size = self.domain.size(query)
        ones = self.spark.range(size).select("id", *coordinates("id", list(query), shape), F.lit(1).alias("cnt"))
        each = self._entries(ones, query).toArrow()
        q = np.zeros((len(place), size))
        for part, at, column, v in zip(*(each.column(c).to_pylist() for c in ("part", "cell", "id", "v"))):
            q[place[part, at], column] = v
        return q, table.column("v").to_numpy()

    def _entries(self, cells: DataFrame, query: Query) -> DataFrame:
        """(id, part, cell, v): the entries of the grid's matrix, for cells (id, attrs...)."""
        shape = self.domain.project(query).shape
        flagged = cells.join(self.own[query].withColumn("_own", F.lit(True)), list(query), "left")
        out = flagged.where("_own").select("id", F.lit("").alias("part"), cell(query, shape).alias("cell"), F.lit(1.0).alias("v"))
        below = self._below(query, self.listed)
        for c in below:
            inside = self._entries(flagged.where("_own IS NULL").select("id", *c), c)
            out = out.unionByName(inside.select("id", self._path(c).alias("part"), "cell", (F.col("v") / math.sqrt(len(below))).alias("v")))
        return out


def measured(df: DataFrame, domain: Domain, queries: Sequence[Query], sigma: float, least: float, seed: str | int = 0, grids: Grids | None = None) -> tuple[Grids, dict[Query, DataFrame]]:
    """The grids of ``queries``, small sets before those that contain them. Rows are counted once for all of
    them, down to the cells of their attributes together; every grid sums those."""
    grids = grids or Grids(df.sparkSession, domain)
    used = [a for a in domain.attrs if any(a in q for q in queries)]
    counts = written(df.groupBy(*used).agg(F.count("*").alias("cnt")), "counts")
    out = {}
    for q in sorted(queries, key=len):
        out[q] = grids.measure(counts.groupBy(*q).agg(F.sum("cnt").alias("cnt")), q, sigma, least, seed)
    return grids, out


def adaptive_grid(df: DataFrame, domain: Domain, eps: float, delta: float, threshold: float = 5.0, targets: Sequence[str] = (), split: Sequence[float] = (1, 1, 1), seed: int = 0, iterations: int = 500) -> Result:
    """A model from grids of each attribute with the targets, and of a tree of pairs with the targets.

    A third of the budget (or ``split``) goes to the grids of all sets of one attribute and some targets, one to the
    choice of a tree by how far each pair is from what the first model says, edge by edge, and one to the grids
    of the chosen sets. ``threshold`` says from how many deviations on a cell counts as occupied."""
    rng = np.random.default_rng(seed)
    ledger = accounting.Ledger(eps, delta)
    first, choice, last = (ledger.rho * s / sum(split) for s in split)
    targets = tuple(a for a in domain.attrs if a in targets)
    free = [a for a in domain.attrs if a not in targets]
    outer = workload.closure([domain.canonical((a, *targets)) for a in free] or [targets])
    sigma = accounting.gaussian_sigma(first, len(outer))
    grids, found = measured(df, domain, outer, sigma, threshold * sigma, f"{seed}a")
    parts = []
    for q, rows in found.items():
        ledger.gaussian(sigma)
        matrix, y = grids.matrix(q, rows)
        parts.append(Measurement(q, y, sigma, matrix))
    model = estimate(domain, parts, iterations=iterations)
    tree: list[Query] = []
    if len(free) > 1:
        pairs = {e: domain.canonical((*e, *targets)) for e in combinations(free, 2)}
        known = answers(marginals.marginals(df, domain, list(pairs.values())), domain, list(pairs.values()))
        seen = model.many(list(pairs.values()))
        gaps = {e: float(np.abs(known[q] - seen[q].flat()).sum()) for e, q in pairs.items()}
        group = {a: {a} for a in free}
        price = accounting.exponential_epsilon(choice, len(free) - 1)
        while len(tree) < len(free) - 1:
            a, b = _choose({e: g for e, g in gaps.items() if group[e[0]] is not group[e[1]]}, price, 1.0, rng)
            ledger.exponential(price)
            tree.append(pairs[a, b])
            joined = group[a] | group[b]
            for x in joined:
                group[x] = joined
        sigma = accounting.gaussian_sigma(last, len(tree))
        _, found = measured(df, domain, tree, sigma, threshold * sigma, f"{seed}b", grids)
        for q, rows in found.items():
            ledger.gaussian(sigma)
            matrix, y = grids.matrix(q, rows)
            parts.append(Measurement(q, y, sigma, matrix))
        model = estimate(domain, parts, iterations=iterations, warm=model)
    return Result(model, ledger, tree)
