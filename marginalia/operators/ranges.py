"""Range workloads over counts by cell: prefixes, ranges, hierarchies, grids, wavelets.

Counts are rows (v, cnt) with v from 0 to n - 1, one row per value; ``dense_line`` makes them so. Running
sums go by ranges of v, with the sums of the ranges before, so that no task holds the whole line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.cells import cell
from marginalia.operators import implicit

STRIDE = 4096  # values of a range in running sums


def dense_line(counts: DataFrame, n: int) -> DataFrame:
    """(v, cnt) for every v below n."""
    return counts.sparkSession.range(n).select(F.col("id").alias("v")).join(counts, "v", "left").select("v", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def prefix_sums(line: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(v, total): sums of all counts up to v."""
    part = F.expr(f"v div {stride}")
    sums = line.groupBy(part.alias("_p")).agg(F.sum("cnt").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_p", part).withColumn("_own", F.sum("cnt").over(inside)).join(starts, "_p").select("v", (F.col("_own") + F.col("_b")).alias("total"))


def suffix_sums(line: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(v, total): sums of all counts from v on."""
    whole = F.broadcast(line.agg(F.sum("cnt").alias("_all")))  # one row
    return prefix_sums(line, stride).join(line, "v").crossJoin(whole).select("v", (F.col("_all") - F.col("total") + F.col("cnt")).alias("total"))


def all_ranges(line: DataFrame) -> DataFrame:
    """(low, high, total) of every range of values: n (n + 1) / 2 rows, as the workload asks."""
    ends = prefix_sums(line).select(F.col("v").alias("high"), F.col("total").alias("_h"))
    starts = prefix_sums(line).join(line, "v").select(F.col("v").alias("low"), (F.col("total") - F.col("cnt")).alias("_l"))
    return starts.join(ends, F.col("low") <= F.col("high")).select("low", "high", (F.col("_h") - F.col("_l")).alias("total"))


def range_queries(line: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``total`` to each (low, high): two lookups in the prefix sums, whatever the ranges' width."""
    sums = prefix_sums(line)
    upper = sums.select(F.col("v").alias("high"), F.col("total").alias("_h"))
    lower = sums.select((F.col("v") + 1).alias("low"), F.col("total").alias("_l"))
    found = queries.join(upper, "high", "left").join(lower, "low", "left")
    return found.select(*queries.columns, (F.coalesce("_h", F.lit(0)) - F.coalesce("_l", F.lit(0))).alias("total"))


def range_queries_2d(grid: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``total`` to each box (x_low, x_high, y_low, y_high) over counts (x, y, cnt), all cells
    present: inclusion and exclusion of four corners of the two-way prefix sums."""
    by_x = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    by_y = Window.partitionBy("x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.withColumn("s", F.sum("cnt").over(by_x)).withColumn("s", F.sum("s").over(by_y)).select("x", "y", "s")
    out = queries
    for name, x, y, dx, dy in (("_a", "x_high", "y_high", 0, 0), ("_b", "x_low", "y_high", 1, 0), ("_c", "x_high", "y_low", 0, 1), ("_d", "x_low", "y_low", 1, 1)):
        corner = sums.select((F.col("x") + dx).alias(x), (F.col("y") + dy).alias(y), F.col("s").alias(name))
        out = out.join(corner, [x, y], "left")
    value = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*queries.columns, (value("_a") - value("_b") - value("_c") + value("_d")).alias("total"))


def box_queries(counts: DataFrame, attrs: Sequence[str], shape: Sequence[int], boxes: DataFrame) -> DataFrame:
    """Adds ``total`` to each row (box, low0, high0, ...) of ``boxes``, in the order of ``attrs``: what the counts
    (attrs..., cnt) have in it. ``box`` tells the rows apart; counts may lack empty cells."""
    x = implicit.vector(counts.groupBy(cell(attrs, shape).alias("i")).agg(F.sum("cnt").alias("v")), math.prod(shape))
    found = implicit.Boxes(boxes.withColumn("i", F.col("box")), 0, shape).apply(x)
    return boxes.join(found.select(F.col("i").alias("box"), F.round("v").cast("long").alias("total")), "box").select(*boxes.columns, "total")


def box_tree_totals(counts: DataFrame, attrs: Sequence[str], branching: int = 2) -> DataFrame:
    """(level, attrs..., total) of a tree of boxes over counts (attrs..., cnt): level 0 has single cells, and a node
    of a level ``branching`` nodes below it along each attribute; empty nodes are left out. The sums combine before the shuffle."""
    top = counts.agg(F.max(F.greatest(*attrs, F.lit(0)))).first()[0] or 0
    levels = 0
    while branching**levels <= top:
        levels += 1
    each = F.array(*(F.struct(F.lit(k).alias("level"), *(F.expr(f"`{a}` div {branching**k}L").alias(a) for a in attrs)) for k in range(levels + 1)))
    return counts.select(F.explode(each).alias("n"), "cnt").groupBy("n.level", *(f"n.{a}" for a in attrs)).agg(F.sum("cnt").alias("total"))


def width_k(line: DataFrame, k: int) -> DataFrame:
    """(low, total) of every range of ``k`` values."""
    sums = prefix_sums(line)
    before = sums.select((F.col("v") + 1).alias("low"), F.col("total").alias("_l"))
    ends = sums.select((F.col("v") - (k - 1)).alias("low"), F.col("total").alias("_h")).where("low >= 0")
    return ends.join(before, "low", "left").select("low", (F.col("_h") - F.coalesce("_l", F.lit(0))).alias("total"))


def hierarchy(line: DataFrame, n: int, branching: int = 2, root: bool = True) -> DataFrame:
    """(level, node, total) of a tree over the values: level 0 holds single values, each node above
    ``branching`` nodes below. A value goes to one node a level; the sums combine before the shuffle."""
    levels = 0
    while branching**levels < n:
        levels += 1
    last = levels if root else max(levels - 1, 0)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"v div {branching**k}L").alias("node")) for k in range(last + 1))))
    return line.select(each.alias("_n"), "cnt").groupBy("_n.level", "_n.node").agg(F.sum("cnt").alias("total"))


def best_branching(n: int, most: int = 64) -> int:
    """The branching of least average error for a line of n values: (b-1) h^3 - 2 (b+1) h^2 / 3."""

    def error(b: int) -> float:
        h = math.ceil(math.log(n) / math.log(b) - 1e-9)
        return (b - 1) * h**3 - 2 * (b + 1) * h**2 / 3

    return min(range(2, max(3, min(n, most) + 1)), key=lambda b: (error(b), b))


def quad_tree(grid: DataFrame, n: int) -> DataFrame:
    """(level, x, y, total) over counts (x, y, cnt) of an n by n grid, n a power of 2; level 0 is single
    cells, the last the whole grid."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("x", k).alias("x"), F.shiftright("y", k).alias("y")) for k in range(n.bit_length()))))
    return grid.select(each.alias("_n"), "cnt").groupBy("_n.level", "_n.x", "_n.y").agg(F.sum("cnt").alias("total"))


def uniform_grid(grid: DataFrame, side: int) -> DataFrame:
    """(gx, gy, total) of square blocks."""
    return grid.groupBy(F.expr(f"x div {side}").alias("gx"), F.expr(f"y div {side}").alias("gy")).agg(F.sum("cnt").alias("total"))


def uniform_side(total: float, epsilon: float, n: int, c: float = 10.0) -> int:
    """The block's side for which noise and uniformity errors balance: sqrt(N eps / c) blocks a side."""
    blocks = max(1, round(math.sqrt(max(total, 0.0) * epsilon / c)))
    return max(1, -(-n // min(blocks, n)))


def adaptive_grid(grid: DataFrame, first: DataFrame, side: int, epsilon: float, c2: float = 5.0) -> DataFrame:
    """(gx, gy, sx, sy, total): each first-level block (gx, gy, noisy) cut again into as many parts a
    side as its noisy count calls for."""
    parts = first.select("gx", "gy", F.greatest(F.lit(1), F.least(F.lit(side), F.ceil(F.sqrt(F.greatest(F.col("noisy"), F.lit(0.0)) * epsilon / c2)).cast("int"))).alias("parts"))
    placed = grid.withColumns({"gx": F.expr(f"x div {side}"), "gy": F.expr(f"y div {side}")}).join(parts, ["gx", "gy"])
    width = F.ceil(F.lit(side) / F.col("parts")).cast("int")
    cut = lambda v, g: F.floor((F.col(v) - F.col(g) * side) / width).cast("int")
    return placed.groupBy("gx", "gy", cut("x", "gx").alias("sx"), cut("y", "gy").alias("sy")).agg(F.sum("cnt").alias("total"))


def haar(line: DataFrame, n: int) -> DataFrame:
    """(level, node, coefficient) of the Haar wavelet of a line of n = 2^k values: level 0 is the total,
    level l the left half less the right half of each of 2^(l-1) parts."""
    k = n.bit_length() - 1
    total = line.agg(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.sum("cnt").alias("coefficient"))
    each = F.explode(F.array(*(F.struct(F.lit(lv).alias("level"), F.expr(f"v div {n >> (lv - 1)}L").alias("node"), (1 - 2 * (F.expr(f"v div {n >> lv}L") % 2)).alias("sign")) for lv in range(1, k + 1))))
    return total.union(line.select(each.alias("_n"), "cnt").groupBy("_n.level", "_n.node").agg(F.sum(F.col("_n.sign") * F.col("cnt")).alias("coefficient")))


def moments(line: DataFrame, k: int) -> DataFrame:
    """(power, total): sums of v^power for powers below k."""
    return line.select(F.explode(F.array(*(F.struct(F.lit(p).alias("power"), (F.pow(F.col("v").cast("double"), p) * F.col("cnt")).alias("x")) for p in range(k)))).alias("m")).groupBy("m.power").agg(F.sum("m.x").alias("total"))


def tree_noise_nodes(steps: Sequence[int]) -> list[tuple[int, int, int]]:
    """(step, level, node): the nodes of a binary counter whose noises sum to the step's prefix noise."""
    out = []
    for t in steps:
        at = 0
        for level in reversed(range(t.bit_length())):
            if t >> level & 1:
                out.append((t, level, at >> level))
                at += 1 << level
    return out


def prefix_marginal(counts: DataFrame, attrs: Sequence[str], along: Sequence[str]) -> DataFrame:
    """Counts (attrs..., cnt) of all cells of a marginal, summed up along some of the attributes: the
    Kronecker product of prefixes on those and identities on the others."""
    for a in along:
        w = Window.partitionBy(*(b for b in attrs if b != a)).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("cnt", F.sum("cnt").over(w))
    return counts.select(*attrs, "cnt")


def random_boxes(spark, shape: Sequence[int], n: int, seed: str | int) -> DataFrame:
    """(box, low0, high0, low1, high1, ...): ``n`` boxes with corners drawn uniformly."""
    from marginalia.functions.rng import keyed_uniform

    out = spark.range(n).withColumnRenamed("id", "box")
    for k, size in enumerate(shape):
        a, b = (F.floor(keyed_uniform(f"{seed}{side}{k}", "box") * size).cast("int") for side in "ab")
        out = out.withColumns({f"low{k}": F.least(a, b), f"high{k}": F.greatest(a, b)})
    return out
