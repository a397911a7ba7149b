"""Propagation on region graphs, as joins over tables of cells: for models whose tables exceed the driver's limit.

A region is a set of attributes with a table of its cells; an edge leads from a region to one inside it. Each
region has a counting number c, the weight of its entropy. A round sends, over all edges at once, what a region
says of its child (up) and what the child says back (down):

    up = c log sum exp((theta + downs of all children but this one - downs to its own parents) / c)
    down = (own c) / (c of the child and of all its parents) (theta + downs of its children + ups of all its parents) - up

With the counting numbers of a junction tree (1 for cliques, -1 for separators) that is belief propagation, and
exact. On graphs with loops the marginals are approximate: regions agree with each other where the rounds settle,
which smaller weights of cliques (see ``lattice``) help. A round is a fixed number of joins and sums over the
table of (edge, cell of the parent, cell of the child), however many regions there are; only the largest change of
a message reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import cell, coordinates
from marginalia.plans.pgm import Clique, JunctionTree
from marginalia.storage import written


@dataclass
class RegionGraph:
    """Regions by number, edges (parent, child), and a counting number for each region. Regions may repeat."""

    domain: Domain
    regions: list[Clique]
    edges: list[tuple[int, int]]
    counting: list[float]

    @classmethod
    def junction(cls, domain: Domain, cliques: Sequence[Clique]) -> RegionGraph:
        """The junction tree of the cliques: each separator is a region below the two cliques that it joins."""
        tree = JunctionTree(domain, cliques)
        regions, edges = list(tree.cliques), []
        for a, b in tree.edges:
            edges += [(a, len(regions)), (b, len(regions))]
            regions.append(tree.separator(a, b))
        return cls(domain, regions, edges, [1.0] * len(tree.cliques) + [-1.0] * len(tree.edges))

    @classmethod
    def lattice(cls, domain: Domain, cliques: Sequence[Clique], weight: float = 1.0) -> RegionGraph:
        """The cliques and all their intersections, each below the smallest regions that contain it. Cliques count
        ``weight``, every other region what makes it and those that contain it count 1 together: 1 gives the
        numbers of Kikuchi, less is closer to a convex objective (2/3 for a loop of three pairs)."""
        found = {domain.canonical(q) for q in cliques}
        fresh = set(found)
        while fresh:
            fresh = {domain.canonical(set(a) & set(b)) for a in fresh for b in found if set(a) & set(b)} - found
            found |= fresh
        regions = sorted(found, key=lambda q: (-len(q), q))
        inside = lambda a, b: set(a) < set(b)
        edges = [(p, r) for p, big in enumerate(regions) for r, small in enumerate(regions) if inside(small, big) and not any(inside(small, x) and inside(x, big) for x in regions)]
        counting: list[float] = []
        for q in regions:  # larger ones come first
            above = [c for x, c in zip(regions, counting) if inside(q, x)]
            counting.append(1.0 - sum(above) if above else weight)
        return cls(domain, regions, edges, counting)

    @classmethod
    def bethe(cls, domain: Domain, cliques: Sequence[Clique]) -> RegionGraph:
        """The cliques and single attributes, with the counting numbers of loopy propagation."""
        outer = [domain.canonical(q) for q in cliques]
        ones = [(a,) for a in domain.attrs if any(a in q for q in outer)]
        edges = [(p, len(outer) + k) for p, q in enumerate(outer) for k, (a,) in enumerate(ones) if a in q]
        return cls(domain, outer + ones, edges, [1.0] * len(outer) + [1.0 - sum(a in q for q in outer) for (a,) in ones])

    def cells(self, spark: SparkSession) -> DataFrame:
        """(region, cell) of all regions."""
        out = None
        for r, q in enumerate(self.regions):
            own = _numbers(spark, self.domain.size(q)).select(F.lit(r).alias("region"), F.col("id").alias("cell"))
            out = own if out is None else out.unionByName(own)
        return out

    def incidence(self, spark: SparkSession) -> DataFrame:
        """(edge, parent, child, high, low): each cell of an edge's parent and the child's cell that it lies in."""
        out = spark.createDataFrame([], "edge int, parent int, child int, high bigint, low bigint")
        for e, (p, r) in enumerate(self.edges):
            big, small = self.domain.project(self.regions[p]), self.domain.project(self.regions[r])
            at = _numbers(spark, self.domain.size(big.attrs)).select("id", *coordinates("id", list(big.attrs), big.shape))
            out = out.unionByName(at.select(F.lit(e).alias("edge"), F.lit(p).alias("parent"), F.lit(r).alias("child"), F.col("id").alias("high"), cell(small.attrs, small.shape).alias("low")))
        return out


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, -(-n // (1 << 20)))


def _by_number(values: Sequence[float], number: str) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(number) + 1)  # a number a region or edge


def propagate(graph: RegionGraph, potentials: DataFrame, total: float = 1.0, rounds: int = 100, damping: float = 0.0, tolerance: float = 1e-9) -> DataFrame:
    """(region, cell, v): the marginals of all regions, times ``total``. ``potentials`` has (region, cell, theta); cells
    that it lacks have theta 0. Rounds end when no message moves by more than ``tolerance``; with ``damping`` each
    keeps that share of what it was. ValueError if a parent's counting number, or one with all its parents', is not
    positive."""
    spark = potentials.sparkSession
    parents = {r: [p for p, child in graph.edges if child == r] for r in range(len(graph.regions))}
    whole = [c + sum(graph.counting[p] for p in parents[r]) for r, c in enumerate(graph.counting)]
    if any(graph.counting[p] <= 0 for p, _ in graph.edges) or min(whole) <= 0:
        raise ValueError("counting numbers must be positive for parents, and for each region with its parents")
    own = graph.cells(spark).join(potentials.select("region", "cell", "theta"), ["region", "cell"], "left")
    own = written(own.select("region", "cell", F.coalesce("theta", F.lit(0.0)).alias("theta")), "regions")
    edges = written(graph.incidence(spark), "edges")
    messages = written(edges.select("edge", "parent", "child", "low").distinct().withColumns({"up": F.lit(0.0), "down": F.lit(0.0)}), "messages")
    count = _by_number(graph.counting, "parent")

    def beliefs(messages: DataFrame) -> DataFrame:
        """(region, cell, s, u, d): theta with what the children say, what the parents say, and what they are told."""
        below = edges.join(messages.select("edge", "low", "down"), ["edge", "low"]).groupBy(F.col("parent").alias("region"), F.col("high").alias("cell")).agg(F.sum("down").alias("b"))
        above = messages.groupBy(F.col("child").alias("region"), F.col("low").alias("cell")).agg(F.sum("up").alias("u"), F.sum("down").alias("d"))
        both = own.join(below, ["region", "cell"], "left").join(above, ["region", "cell"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return both.select("region", "cell", (F.col("theta") + zero("b")).alias("s"), zero("u").alias("u"), zero("d").alias("d"))

    for _ in range(rounds):
        now = written(beliefs(messages), "beliefs")
        said = edges.join(now.select(F.col("region").alias("parent"), F.col("cell").alias("high"), (F.col("s") - F.col("d")).alias("s")), ["parent", "high"])
        said = said.join(messages.select("edge", "low", "down"), ["edge", "low"]).withColumn("x", (F.col("s") - F.col("down")) / count)
        said = said.withColumn("top", F.max("x").over(Window.partitionBy("edge", "low")))  # sums follow where the rows are
        ups = said.groupBy("edge", "low", "parent", "child").agg(((F.max("top") + F.log(F.sum(F.exp(F.col("x") - F.col("top"))))) * F.first(count)).alias("new_up"))
        # only differences of a message count: its largest value is taken off
        ups = written(ups.join(ups.groupBy("edge").agg(F.max("new_up").alias("most")), "edge").select("edge", "low", "parent", "child", (F.col("new_up") - F.col("most")).alias("new_up")), "ups")
        heard = ups.groupBy(F.col("child").alias("region"), F.col("low").alias("cell")).agg(F.sum("new_up").alias("all_ups"))
        child = now.join(heard, ["region", "cell"]).select(F.col("region").alias("child"), F.col("cell").alias("low"), (F.col("s") + F.col("all_ups")).alias("t"))
        after = ups.join(child, ["child", "low"]).join(messages.select("edge", "low", "up", "down"), ["edge", "low"])
        fresh = count / _by_number(whole, "child") * F.col("t") - F.col("new_up")
        mixed = lambda old, new: damping * F.col(old) + (1 - damping) * new
        after = after.select("edge", "parent", "child", "low", mixed("up", F.col("new_up")).alias("up"), mixed("down", fresh).alias("down"), F.abs(fresh - F.col("down")).alias("moved"))
        after = written(after, "messages")
        moved = after.agg(F.max("moved")).first()[0]
        messages = after.drop("moved")
        if moved is None or moved <= tolerance:
            break
    last = beliefs(messages).select("region", "cell", ((F.col("s") + F.col("u")) / _by_number(whole, "region")).alias("x"))
    most = last.groupBy("region").agg(F.max("x").alias("most"))  # a row a region
    raised = last.join(most, "region").withColumn("w", F.exp(F.col("x") - F.col("most")))
    sums = raised.groupBy("region").agg(F.sum("w").alias("z"))
    return raised.join(sums, "region").select("region", "cell", (F.col("w") / F.col("z") * total).alias("v"))
