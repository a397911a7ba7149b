"""Partitions of a line of cells into dyadic buckets of similar counts, and estimates from them, in one and two
dimensions.

A bucket of 2^l cells that starts at a multiple of 2^l costs how far its cells are from their mean, plus a price for
its own noise. The cheapest partition follows from the leaves up: a node is either one bucket or the best of its two
halves. Blocks of 2^BLOCK cells work theirs out in numpy, a block a task at a time; what lies above the blocks is a
few joins over tables of one row a block, so no task holds the line. Grids go along the Hilbert curve, where buckets are
squares and pairs of squares.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_laplace
from marginalia.operators import implicit, partition
from marginalia.operators.ordered import numbered
from marginalia.plans import cells
from marginalia.storage import written

BLOCK = 12
_OUT = "kind string, level int, node bigint, cost double"


def _laplace(seed: str, level: int, nodes: np.ndarray) -> np.ndarray:
    """rng.keyed_laplace of (level, node), in numpy."""
    u = np.array([(int(hashlib.md5(f"{seed}|{level}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296 for k in nodes.tolist()]) - 0.5
    return -np.sign(u) * np.log(1 - 2 * np.abs(u))


def _block(x: np.ndarray, first: int, price: float, scale: float, seed: str) -> tuple[float, list[tuple[int, int]]]:
    """The least cost of a block of 2^k cells whose number among such blocks is ``first``, and its buckets (level, node)."""
    k = len(x).bit_length() - 1
    best, alone = [np.full(len(x), price)], [np.ones(len(x), dtype=bool)]
    for level in range(1, k + 1):
        parts = x.reshape(-1, 1 << level)
        cost = np.abs(parts - parts.mean(axis=1, keepdims=True)).sum(axis=1)
        if scale:
            cost = np.maximum(cost + scale * _laplace(seed, level, (first << (k - level)) + np.arange(len(parts))), 0)
        halves = best[-1].reshape(-1, 2).sum(axis=1)
        alone.append(cost + price <= halves)
        best.append(np.where(alone[-1], cost + price, halves))
    out, at = [], np.zeros(1, dtype=np.int64)  # nodes that are not within a bucket above
    for level in range(k, -1, -1):
        one = alone[level][at]
        out += [(level, (first << (k - level)) + int(n)) for n in at[one]]
        at = (at[~one][:, None] * 2 + np.arange(2)).ravel()
    return float(best[k][0]), out


def dyadic_partition(line: DataFrame, n: int, price: float, scale: float = 0.0, seed: str | int = 0, block: int = BLOCK) -> DataFrame:
    """(level, node): the buckets of the least cost for cells (i, v) with every i below n, a power of 2; a bucket has the
    cells from node 2^level on. ``price`` is that of a bucket, ``scale`` the Laplace noise of its cost (keyed by the seed, level
    and node; costs of single cells are 0 and need none). Ties go to the larger bucket."""
    if n & (n - 1):
        raise ValueError("the number of cells must be a power of 2")
    top = n.bit_length() - 1
    low, seed = min(block, top), str(seed)
    above = list(range(low + 1, top + 1))
    cut = line.select(F.expr(f"shiftright(i, {low})").alias("block"), "i", F.col("v").cast("double").alias("v"))
    means = written(cut.groupBy("block").agg(F.sum("v").alias("s0")), "sums")
    for k, level in enumerate(above):  # the sums of all nodes above a block, next to it
        sums = means.groupBy(F.expr(f"shiftright(block, {k + 1})").alias("_up")).agg(F.sum("s0").alias(f"s{k + 1}"))
        means = means.join(sums, F.expr(f"shiftright(block, {k + 1})") == F.col("_up")).drop("_up")

    def work(key, rows: pa.Table, told: pa.Table) -> pa.Table:
        number = key[0].as_py()
        x = rows.column("v").to_numpy()[np.argsort(rows.column("i").to_numpy(), kind="stable")]
        cost, buckets = _block(x, number, price, scale, seed)
        out = [("best", low, number, cost)] + [("bucket", level, node, 0.0) for level, node in buckets]
        for k, level in enumerate(above):
            mean = told.column(f"s{k + 1}")[0].as_py() / (1 << level)
            out.append(("spread", level, number >> (k + 1), float(np.abs(x - mean).sum())))
        return pa.table([pa.array(c) for c in zip(*out)], schema=pa.schema([("kind", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("cost", pa.float64())]))

    found = written(cut.groupBy("block").cogroup(means.groupBy("block")).applyInArrow(work, _OUT), "buckets")
    own = found.where("kind = 'bucket'").select("level", "node")
    if not above:
        return own
    spread = found.where("kind = 'spread'").groupBy("level", "node").agg(F.sum("cost").alias("cost"))
    noise = scale * keyed_laplace(seed, "level", "node") if scale else F.lit(0.0)
    spread = written(spread.withColumn("cost", F.greatest(F.col("cost") + noise, F.lit(0.0)) + price), "spread")
    best = found.where("kind = 'best'").select("node", F.col("cost").alias("best"))
    tables = []
    for level in above:
        halves = best.groupBy(F.expr("shiftright(node, 1)").alias("node")).agg(F.sum("best").alias("halves"))
        now = halves.join(spread.where(F.col("level") == level).select("node", "cost"), "node")
        now = written(now.select("node", (F.col("cost") <= F.col("halves")).alias("alone"), F.least("cost", "halves").alias("best")), "level")
        tables.append(now)
        best = now.select("node", "best")
    out, open_nodes = own.limit(0), tables[-1].select("node")
    for level, now in reversed(list(zip(above, tables))):
        here = now.join(open_nodes, "node")
        out = out.unionByName(here.where("alone").select(F.lit(level).alias("level"), "node"))
        open_nodes = here.where("NOT alone").select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    inside = own.withColumn("_block", F.expr(f"shiftright(node, {low} - level)")).join(open_nodes.withColumnRenamed("node", "_block"), "_block")
    return out.unionByName(inside.select("level", "node"))


def dawa(line: DataFrame, n: int, eps: float, seed: str | int, ratio: float = 0.25, branching: int = 2) -> DataFrame:
    """(i, v): an estimate of the cells (i, v) of a line. ``ratio`` of the budget goes to the partition; the buckets'
    totals are then measured through a tree over them, fitted by least squares, and spread evenly over their cells."""
    first, second = ratio * eps, (1 - ratio) * eps
    levels = max(1, n.bit_length() - 1)
    # a row of the data moves the cost of one node a level, by 2 at most
    chosen = dyadic_partition(line, n, 1 / second, 2 * levels / first, f"{seed}partition")
    starts = written(chosen.select(F.expr("shiftleft(node, level)").alias("start"), F.expr("shiftleft(1L, level)").alias("size")), "chosen")
    groups = written(numbered(starts, ["start"], "g"), "groups")
    of = groups.select("g", "size", F.explode(F.expr("sequence(start, start + size - 1)")).alias("i"))
    count = groups.count()
    totals = line.join(of, "i").groupBy(F.col("g").alias("i")).agg(F.sum("v").alias("v"))
    tree = implicit.Tree(count, branching)
    scale = len(tree.sizes) / second
    answers = written(tree.apply(totals).withColumn("v", F.col("v") + scale * keyed_laplace(f"{seed}totals", "i")), "answers")
    fit = cells.least_squares([(tree, answers, scale)]).withColumnRenamed("i", "g")
    return of.join(fit, "g").select("i", (F.col("v") / F.col("size")).alias("v"))


def along_hilbert(grid: DataFrame, side: int) -> DataFrame:
    """(i, v, cell) for counts (x, y, cnt) of a square grid: each cell at its place on the Hilbert curve."""
    places = partition.hilbert(grid.sparkSession, side).select("cell", F.col("group").alias("i"))
    counts = grid.groupBy((F.col("x").cast("long") * side + F.col("y")).alias("cell")).agg(F.sum("cnt").alias("v"))
    return places.join(counts, "cell", "left").select("i", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), "cell")


def dawa_2d(grid: DataFrame, side: int, eps: float, seed: str | int, **how) -> DataFrame:
    """(x, y, v): the same for counts (x, y, cnt) of a grid, ``side`` a power of 2."""
    line = written(along_hilbert(grid, side), "line")
    found = dawa(line.select("i", "v"), side * side, eps, seed, **how)
    return found.join(line.select("i", "cell"), "i").select(F.expr(f"CAST(cell div {side} AS INT)").alias("x"), (F.col("cell") % side).cast("int").alias("y"), "v")
