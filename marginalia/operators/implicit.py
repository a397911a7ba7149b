"""Query matrices that are never written out: operators on tables of cells.

A vector of n numbers is a table (i, v) with one row for each i below n. An operator takes such a table to
that of its answers (apply), and answers back to cells (adjoint); both are plans of joins, sums and windows
of about n rows, whatever the number of entries of the matrix. Operators combine: Stack, Beside, Weighted,
Sum, Product, Kronecker. ``by`` names further columns that tell vectors of one table apart; each vector is
then taken by itself, which is how a Kronecker product works on one side at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRIDE = 4096  # values of a range in running sums, or the square root of all if that is more

By = Sequence[str]


def vector(counts: DataFrame, n: int, i: str = "i", v: str = "v") -> DataFrame:
    """(i, v) for every i below n; what ``counts`` lacks is 0."""
    some = counts.select(F.col(i).cast("long").alias("i"), F.col(v).cast("double").alias("v"))
    return counts.sparkSession.range(n).select(F.col("id").alias("i")).join(some, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


def _filled(y: DataFrame, like: DataFrame, n: int, by: By) -> DataFrame:
    """Sums of (by, i, v), and 0 for the other i below n of each vector in ``like``."""
    numbers = like.sparkSession.range(n).select(F.col("id").alias("i"))
    every = like.select(*by).distinct().crossJoin(numbers) if by else numbers  # as many rows as the result
    return y.select(*by, "i", "v").unionByName(every.select(*by, "i", F.lit(0.0).alias("v"))).groupBy(*by, "i").agg(F.sum("v").alias("v"))


def running(x: DataFrame, n: int, by: By = (), back: bool = False) -> DataFrame:
    """Sums of each vector up to each i, or from each i on. Ranges of i add up by themselves, and then what comes
    before a range; neither has more rows than the larger of STRIDE and the square root of n."""
    stride = max(STRIDE, math.isqrt(n))
    order = lambda c: F.col(c).desc() if back else F.col(c)
    inside = Window.partitionBy(*by, "_r").orderBy(order("i")).rowsBetween(Window.unboundedPreceding, 0)
    ranged = x.withColumn("_r", F.expr(f"i div {stride}")).withColumn("_own", F.sum("v").over(inside))
    if n <= stride:
        return ranged.select(*by, "i", F.col("_own").alias("v"))
    sums = x.groupBy(*by, F.expr(f"i div {stride}").alias("_r")).agg(F.sum("v").alias("_s"))
    before = Window.partitionBy(*by).orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_r", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_b"))
    return ranged.join(starts, [*by, "_r"]).select(*by, "i", (F.col("_own") + F.col("_b")).alias("v"))


class Operator:
    """A matrix of ``rows`` x ``columns`` by what it does."""

    rows: int
    columns: int

    def apply(self, x: DataFrame, by: By = ()) -> DataFrame:
        """The matrix times each vector."""
        raise NotImplementedError

    def adjoint(self, y: DataFrame, by: By = ()) -> DataFrame:
        """The transposed matrix times each vector."""
        raise NotImplementedError

    def absolute(self) -> Operator:
        """The operator of the entries' absolute values; those of most are their own."""
        return self

    def column_norms(self, spark: SparkSession) -> DataFrame:
        """(i, v): the sum of absolute values of each column."""
        return self.absolute().adjoint(ones(spark, self.rows))

    def sensitivity(self, spark: SparkSession) -> float:
        """The largest sum of absolute values of a column."""
        return self.column_norms(spark).agg(F.max("v")).first()[0]


class Identity(Operator):
    def __init__(self, n: int):
        self.rows = self.columns = n

    def apply(self, x, by=()):
        return x.select(*by, "i", "v")

    adjoint = apply


class Total(Operator):
    """One row of ones."""

    def __init__(self, n: int):
        self.rows, self.columns = 1, n

    def apply(self, x, by=()):
        return x.groupBy(*by).agg(F.sum("v").alias("v")).select(*by, F.lit(0).cast("long").alias("i"), "v")

    def adjoint(self, y, by=()):
        return y.select(*by, "v").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.columns - 1).cast("long")))).select(*by, "i", "v") if self.columns <= STRIDE else y.sparkSession.range(self.columns).select(F.col("id").alias("i")).crossJoin(y.select(*by, "v")).select(*by, "i", "v")


class Prefix(Operator):
    """Row k sums the cells up to k."""

    def __init__(self, n: int):
        self.rows = self.columns = n

    def apply(self, x, by=()):
        return running(x, self.columns, by)

    def adjoint(self, y, by=()):
        return running(y, self.columns, by, back=True)


class Ranges(Operator):
    """A row for each (i, low, high) of a table: the cells from low to high, both included, 0 <= low <= high < n."""

    def __init__(self, spans: DataFrame, rows: int, n: int):
        self.spans, self.rows, self.columns = spans.select(F.col("i").cast("long").alias("i"), "low", "high"), rows, n

    def apply(self, x, by=()):
        sums = running(x, self.columns, by)
        ends = self.spans.select("i", F.explode(F.array(F.struct(F.col("high").alias("at"), F.lit(1.0).alias("sign")), F.struct((F.col("low") - 1).alias("at"), F.lit(-1.0).alias("sign")))).alias("e"))
        ends = ends.select(F.col("i").alias("_q"), F.col("e.at").cast("long").alias("i"), "e.sign").where("i >= 0")
        return ends.join(sums, "i").groupBy(*by, F.col("_q").alias("i")).agg(F.sum(F.col("sign") * F.col("v")).alias("v"))

    def adjoint(self, y, by=()):
        """Each answer is added where its range begins and taken off where it has ended; the rest is running sums."""
        steps = F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("v").alias("s")), F.struct((F.col("high") + 1).alias("at"), (-F.col("v")).alias("s")))).alias("e")
        changes = y.join(self.spans, "i").select(*by, steps).select(*by, F.col("e.at").cast("long").alias("i"), F.col("e.s").alias("v")).where(F.col("i") < self.columns)
        return running(_filled(changes, y, self.columns, by), self.columns, by)


class Tree(Operator):
    """Ranges of a tree over n cells: rows 0 to n - 1 are the cells, then come the nodes above, each with
    ``branching`` below it, level by level up to the root."""

    def __init__(self, n: int, branching: int = 2):
        self.columns, self.branching, self.sizes = n, branching, [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // branching))
        self.starts = [sum(self.sizes[:k]) for k in range(len(self.sizes))]
        self.rows = sum(self.sizes)

    def apply(self, x, by=()):
        each = F.explode(F.array(*(F.expr(f"{start}L + i div {self.branching**k}L") for k, start in enumerate(self.starts))))
        return x.select(*by, each.alias("i"), "v").groupBy(*by, "i").agg(F.sum("v").alias("v"))

    def adjoint(self, y, by=()):
        """From the root down, each node passes on what has come to it."""
        level = lambda k: y.where((F.col("i") >= self.starts[k]) & (F.col("i") < self.starts[k] + self.sizes[k])).select(*by, (F.col("i") - self.starts[k]).alias("i"), "v")
        down = level(len(self.sizes) - 1)
        for k in reversed(range(len(self.sizes) - 1)):
            above = down.select(*by, F.col("i").alias("_up"), F.col("v").alias("_v"))
            own = level(k).withColumn("_up", F.expr(f"i div {self.branching}L"))
            down = own.join(above, [*by, "_up"]).select(*by, "i", (F.col("v") + F.col("_v")).alias("v"))
        return down


class Blocks(Operator):
    """Sums of ``width`` cells side by side, the last of what is left."""

    def __init__(self, n: int, width: int):
        self.rows, self.columns, self.width = -(-n // width), n, width

    def apply(self, x, by=()):
        return x.groupBy(*by, F.expr(f"i div {self.width}L").alias("i")).agg(F.sum("v").alias("v"))

    def adjoint(self, y, by=()):
        last = F.least((F.col("i") + 1) * self.width, F.lit(self.columns)) - 1
        return y.select(*by, F.explode(F.sequence(F.col("i") * self.width, last)).alias("i"), "v")


class Boxes(Operator):
    """A row for each box (i, low0, high0, low1, high1, ...) of a table, in a domain of the given sizes; both ends
    are included and lie in the domain. Running sums along every attribute, one after the other, and then two to the
    number of attributes lookups a box, whatever its volume."""

    def __init__(self, boxes: DataFrame, rows: int, shape: Sequence[int]):
        self.shape, self.rows, self.columns = list(shape), rows, math.prod(shape)
        self.sums = Kronecker([Prefix(n) for n in shape])
        corners = [(F.lit(0).cast("long"), 1.0, F.lit(True))]
        for k, n in enumerate(shape):
            high, low = F.col(f"high{k}").cast("long"), F.col(f"low{k}").cast("long") - 1
            corners = [c for at, sign, inside in corners for c in ((at * n + high, sign, inside), (at * n + low, -sign, inside & (low >= 0)))]
        each = F.explode(F.filter(F.array(*(F.struct(at.alias("at"), F.lit(sign).alias("sign"), inside.alias("inside")) for at, sign, inside in corners)), lambda c: c["inside"]))
        self.corners = boxes.select(F.col("i").cast("long").alias("_q"), each.alias("c")).select("_q", F.col("c.at").alias("i"), F.col("c.sign").alias("sign"))

    def apply(self, x, by=()):
        return self.corners.join(self.sums.apply(x, by), "i").groupBy(*by, F.col("_q").alias("i")).agg(F.sum(F.col("sign") * F.col("v")).alias("v"))

    def adjoint(self, y, by=()):
        answers = y.withColumnRenamed("i", "_q")
        changes = self.corners.join(answers, "_q").select(*by, "i", (F.col("sign") * F.col("v")).alias("v"))
        return self.sums.adjoint(_filled(changes, answers, self.columns, by), by)


class Haar(Operator):
    """The wavelet of n = 2^k cells: row 0 is the total; rows 2^(l-1) to 2^l - 1 are, for each of as many parts, the
    left half less the right half."""

    def __init__(self, n: int, signed: bool = True):
        if n & (n - 1):
            raise ValueError("the number of cells must be a power of 2")
        self.rows = self.columns = n
        self.signed = signed

    def _each(self) -> Column:
        n, levels = self.columns, range(1, self.columns.bit_length())
        sign = lambda lv: F.expr(f"1 - 2 * (i div {n >> lv}L % 2)") if self.signed else F.lit(1)
        first = F.struct(F.lit(0).cast("long").alias("row"), F.lit(1).cast("double").alias("sign"))
        return F.explode(F.array(first, *(F.struct(F.expr(f"{1 << (lv - 1)}L + i div {n >> (lv - 1)}L").alias("row"), sign(lv).cast("double").alias("sign")) for lv in levels)))

    def apply(self, x, by=()):
        return x.select(*by, self._each().alias("e"), "v").groupBy(*by, F.col("e.row").alias("i")).agg(F.sum(F.col("e.sign") * F.col("v")).alias("v"))

    def adjoint(self, y, by=()):
        cells = y.sparkSession.range(self.columns).select(F.col("id").alias("i")).select("i", self._each().alias("e")).select(F.col("i").alias("_c"), F.col("e.row").alias("i"), "e.sign")
        return cells.join(y, "i").groupBy(*by, F.col("_c").alias("i")).agg(F.sum(F.col("sign") * F.col("v")).alias("v"))

    def absolute(self):
        return Haar(self.columns, signed=False)


class Entries(Operator):
    """A matrix by a table (q, cell, val) of its entries, as in operators.matrix."""

    def __init__(self, entries: DataFrame, rows: int, columns: int):
        self.entries, self.rows, self.columns = entries, rows, columns

    def _times(self, x, by, source, target, n):
        found = self.entries.select(F.col(source).alias("i"), F.col(target).alias("_t"), "val").join(x, "i")
        return _filled(found.select(*by, F.col("_t").alias("i"), (F.col("val") * F.col("v")).alias("v")), x, n, by)

    def apply(self, x, by=()):
        return self._times(x, by, "cell", "q", self.rows)

    def adjoint(self, y, by=()):
        return self._times(y, by, "q", "cell", self.columns)

    def absolute(self):
        return Entries(self.entries.withColumn("val", F.abs("val")), self.rows, self.columns)


class Weighted(Operator):
    def __init__(self, base: Operator, weight: float):
        self.base, self.weight, self.rows, self.columns = base, float(weight), base.rows, base.columns

    def _scaled(self, x, by):
        return x.select(*by, "i", (F.col("v") * self.weight).alias("v"))

    def apply(self, x, by=()):
        return self._scaled(self.base.apply(x, by), by)

    def adjoint(self, y, by=()):
        return self._scaled(self.base.adjoint(y, by), by)

    def absolute(self):
        base = self.base.absolute()
        return self if base is self.base and self.weight >= 0 else Weighted(base, abs(self.weight))


class Stack(Operator):
    """Operators over the same cells, their answers one after the other."""

    def __init__(self, parts: Sequence[Operator]):
        self.parts, self.columns = list(parts), parts[0].columns
        if any(p.columns != self.columns for p in parts):
            raise ValueError("the parts have different numbers of columns")
        self.starts = [sum(p.rows for p in self.parts[:k]) for k in range(len(self.parts))]
        self.rows = sum(p.rows for p in self.parts)

    def apply(self, x, by=()):
        out = None
        for start, part in zip(self.starts, self.parts):
            own = part.apply(x, by).select(*by, (F.col("i") + start).alias("i"), "v")
            out = own if out is None else out.unionByName(own)
        return out

    def adjoint(self, y, by=()):
        out = None
        for start, part in zip(self.starts, self.parts):
            own = y.where((F.col("i") >= start) & (F.col("i") < start + part.rows)).select(*by, (F.col("i") - start).alias("i"), "v")
            found = part.adjoint(own, by)
            out = found if out is None else out.unionByName(found)
        return out if len(self.parts) == 1 else out.groupBy(*by, "i").agg(F.sum("v").alias("v"))

    def absolute(self):
        parts = [p.absolute() for p in self.parts]
        return self if all(a is p for a, p in zip(parts, self.parts)) else Stack(parts)


class Sum(Operator):
    """Operators of one shape, added."""

    def __init__(self, parts: Sequence[Operator]):
        self.parts, self.rows, self.columns = list(parts), parts[0].rows, parts[0].columns
        if any((p.rows, p.columns) != (self.rows, self.columns) for p in parts):
            raise ValueError("the parts have different shapes")

    def _added(self, found: list[DataFrame], by):
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.groupBy(*by, "i").agg(F.sum("v").alias("v"))

    def apply(self, x, by=()):
        return self._added([p.apply(x, by) for p in self.parts], by)

    def adjoint(self, y, by=()):
        return self._added([p.adjoint(y, by) for p in self.parts], by)

    def absolute(self):
        if any(p.absolute() is not p for p in self.parts):
            raise NotImplementedError("entries of a sum may cancel; write it as Entries")
        return self


class Product(Operator):
    """``left`` of what ``right`` answers."""

    def __init__(self, left: Operator, right: Operator):
        if left.columns != right.rows:
            raise ValueError("left must have as many columns as right has rows")
        self.left, self.right, self.rows, self.columns = left, right, left.rows, right.columns

    def apply(self, x, by=()):
        return self.left.apply(self.right.apply(x, by), by)

    def adjoint(self, y, by=()):
        return self.right.adjoint(self.left.adjoint(y, by), by)

    def absolute(self):
        if self.left.absolute() is not self.left or self.right.absolute() is not self.right:
            raise NotImplementedError("entries of a product may cancel; write it as Entries")
        return self


class Transposed(Operator):
    def __init__(self, base: Operator):
        self.base, self.rows, self.columns = base, base.columns, base.rows

    def apply(self, x, by=()):
        return self.base.adjoint(x, by)

    def adjoint(self, y, by=()):
        return self.base.apply(y, by)

    def absolute(self):
        return self if self.base.absolute() is self.base else Transposed(self.base.absolute())


def beside(parts: Sequence[Operator]) -> Operator:
    """Operators with as many rows, their columns one after the other; the answers add up."""
    return Transposed(Stack([Transposed(p) for p in parts]))


class Kronecker(Operator):
    """The product of operators on the attributes of a domain, the last one's cells side by side. Each is
    applied on its own attribute, for all values of the others."""

    def __init__(self, parts: Sequence[Operator]):
        self.parts = list(parts)
        self.rows, self.columns = (math.prod(getattr(p, side) for p in parts) for side in ("rows", "columns"))

    def _times(self, x: DataFrame, by: By, forward: bool) -> DataFrame:
        sizes = [p.columns if forward else p.rows for p in self.parts]
        # an index for each attribute; when an operator has been applied, its own holds its answers
        depth = 1 + max([int(b[2:].split("_")[0]) for b in by if b.startswith("_k")], default=-1)
        names, rest = [f"_k{depth}_{k}" for k in range(len(sizes))], F.col("i")
        for k in reversed(range(len(sizes))):
            x = x.withColumn(names[k], F.pmod(rest, F.lit(sizes[k])))
            rest = F.expr(f"i div {math.prod(sizes[k:])}L")
        x = x.drop("i")
        for k, part in enumerate(self.parts):
            others = [*by, *(n for n in names if n != names[k])]
            moved = x.withColumnRenamed(names[k], "i")
            found = part.apply(moved, others) if forward else part.adjoint(moved, others)
            x = found.withColumnRenamed("i", names[k])
        index = F.lit(0).cast("long")
        for name, part in zip(names, self.parts):
            index = index * (part.rows if forward else part.columns) + F.col(name)
        return x.select(*by, index.alias("i"), "v")

    def apply(self, x, by=()):
        return self._times(x, by, True)

    def adjoint(self, y, by=()):
        return self._times(y, by, False)

    def absolute(self):
        parts = [p.absolute() for p in self.parts]
        return self if all(a is p for a, p in zip(parts, self.parts)) else Kronecker(parts)


def box_tree(shape: Sequence[int], branching: int = 2, root: bool = True, leaves: bool = True) -> Stack:
    """A tree of boxes over a domain of any number of attributes: each level cuts every attribute that is still
    wider than a cell into ``branching`` parts. Rows go from the cells up, level by level, each in the order of the
    attributes; ``root`` and ``leaves`` say whether the total and the single cells are among them."""
    parts, width = [], 1
    while width == 1 or width < max(shape) * branching:
        level = [Blocks(n, min(width, n)) for n in shape]
        if (leaves or width > 1) and (root or any(b.rows > 1 for b in level)):
            parts.append(Kronecker(level))
        width *= branching
    return Stack(parts)
