"""Named queries over tables of cells: operators that are never written out, inference, boxes and trees of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import table
from marginalia.functions.rng import keyed_laplace
from marginalia.operators import implicit, marginals, ranges
from marginalia.plans import cells, dyadic
from marginalia.queries import ITEMS, ITEMS_SQL, items, query, uniform_sql

LINE = 1_000_000  # cells of prices
BOX_ATTRS, BOX_SHAPE = ("q", "d", "mo", "t"), (50, 11, 12, 9)
BOX_SQL = """
enc AS (SELECT CAST(l_quantity AS INTEGER) - 1 AS q, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(month(l_shipdate) - 1 AS INTEGER) AS mo,
               CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem),
boxes AS (SELECT s_suppkey AS box, s_suppkey % 50 AS low0, least(49, s_suppkey % 50 + s_nationkey) AS high0, s_suppkey % 11 AS low1, least(10, s_suppkey % 11 + 3) AS high1,
                 s_nationkey % 12 AS low2, greatest(s_nationkey % 12, s_suppkey % 12) AS high2, s_suppkey % 9 AS low3, greatest(s_suppkey % 9, s_nationkey % 9) AS high3 FROM supplier)"""


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem by quantity, discount, month and tax."""
    rows = table(spark, sf_dir, "lineitem")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    return rows.select((F.col("l_quantity").cast("int") - 1).alias("q"), hundredths("l_discount").alias("d"), (F.month("l_shipdate") - 1).alias("mo"), hundredths("l_tax").alias("t"))


def boxes(spark: SparkSession, sf_dir: str, attrs: int) -> DataFrame:
    """A box of the first ``attrs`` attributes for every supplier."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    sides = [
        (key % 50, F.least(F.lit(49), key % 50 + nation)), (key % 11, F.least(F.lit(10), key % 11 + 3)),
        (nation % 12, F.greatest(nation % 12, key % 12)), (key % 9, F.greatest(key % 9, nation % 9)),
    ]
    return table(spark, sf_dir, "supplier").select(key.alias("box"), *(c.alias(f"{side}{k}") for k, both in enumerate(sides[:attrs]) for side, c in zip(("low", "high"), both)))


def _box_sql(attrs: int) -> str:
    inside = " AND ".join(f"{a} BETWEEN low{k} AND high{k}" for k, a in enumerate(BOX_ATTRS[:attrs]))
    columns = ", ".join(f"{side}{k}" for k in range(attrs) for side in ("low", "high"))
    return f"WITH {BOX_SQL} SELECT box, {columns}, count(q) AS total FROM boxes LEFT JOIN enc ON {inside} GROUP BY ALL"


def _boxes_over(spark: SparkSession, sf_dir: str, attrs: int) -> DataFrame:
    names = BOX_ATTRS[:attrs]
    counts = box_rows(spark, sf_dir).groupBy(*names).agg(F.count("*").alias("cnt"))
    return ranges.box_queries(counts, names, BOX_SHAPE[:attrs], boxes(spark, sf_dir, attrs))


@query("box_queries_3d", _box_sql(3))
def box_queries_3d(spark, sf_dir):
    return _boxes_over(spark, sf_dir, 3)


@query("box_queries_4d", _box_sql(4))
def box_queries_4d(spark, sf_dir):
    return _boxes_over(spark, sf_dir, 4)


@query("box_tree_3d", f"WITH {BOX_SQL} SELECT CAST(k AS INTEGER) AS level, CAST(q // (1 << k) AS BIGINT) AS q, CAST(d // (1 << k) AS BIGINT) AS d, CAST(mo // (1 << k) AS BIGINT) AS mo, count(*) AS total FROM enc, range(7) r(k) GROUP BY ALL")
def box_tree_3d(spark, sf_dir):
    counts = box_rows(spark, sf_dir).groupBy("q", "d", "mo").agg(F.count("*").alias("cnt"))
    return ranges.box_tree_totals(counts, ["q", "d", "mo"])


def noisy(op: implicit.Operator, x: DataFrame, scale: float, seed: str) -> DataFrame:
    """An operator's answers with Laplace noise."""
    return op.apply(x).withColumn("v", F.col("v") + scale * keyed_laplace(seed, "i"))


def laplace_sql(seed: str, key: str = "i") -> str:
    u = f"({uniform_sql(seed, key)} - 0.5)"
    return f"(-sign({u}) * ln(1 - 2 * abs({u})))"


def _tree_sql(n: int, b: int) -> str:
    """The least-squares fit of a complete tree in closed form: estimates from below, then from above."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(sizes[-1] // b)
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    parts = [
        f"""h AS (SELECT least({n - 1}, CAST(floor(l_extendedprice * 9) AS BIGINT)) AS i, count(*) AS c FROM lineitem GROUP BY ALL),
        c0 AS (SELECT range AS i, coalesce(c, 0) AS c FROM range({n}) LEFT JOIN h ON range = i)"""
    ]
    parts += [f"c{k} AS (SELECT i // {b} AS i, sum(c) AS c FROM c{k - 1} GROUP BY ALL)" for k in range(1, len(sizes))]
    parts += [f"y{k} AS (SELECT i, c + 2.0 * {laplace_sql('cells', f'(i + {starts[k]})')} AS y FROM c{k})" for k in range(len(sizes))]
    parts.append("z0 AS (SELECT i, y AS z, 0.0 AS s FROM y0)")
    for k in range(1, len(sizes)):
        own = (b ** (k + 1) - b**k) / (b ** (k + 1) - 1)
        parts.append(f"z{k} AS (SELECT y{k}.i, {own!r} * y + (1 - {own!r}) * s AS z, s FROM y{k} JOIN (SELECT i // {b} AS i, sum(z) AS s FROM z{k - 1} GROUP BY ALL) USING (i))")
    top = len(sizes) - 1
    parts.append(f"x{top} AS (SELECT i, z AS x, s FROM z{top})")
    parts += [f"x{k} AS (SELECT z{k}.i, z{k}.z + (x{k + 1}.x - x{k + 1}.s) / {b} AS x, z{k}.s FROM z{k} JOIN x{k + 1} ON z{k}.i // {b} = x{k + 1}.i)" for k in reversed(range(top))]
    return "WITH " + ", ".join(parts) + " SELECT i // 1000 AS part, round(sum(x), 3) AS total FROM x0 GROUP BY ALL"


@query("cell_least_squares", _tree_sql(LINE, 100))
def cell_least_squares(spark, sf_dir):
    """A million cells of prices from noisy answers to a tree of ranges; the sums of thousand cells each."""
    place = F.least(F.lit(LINE - 1), F.floor(F.col("l_extendedprice") * 9))
    x = implicit.vector(table(spark, sf_dir, "lineitem").groupBy(place.alias("i")).agg(F.count("*").alias("v")), LINE)
    tree = implicit.Tree(LINE, 100)
    fit = cells.least_squares([(tree, noisy(tree, x, 2.0, "cells"), 2.0)])
    return fit.groupBy(F.expr("i div 1000").alias("part")).agg(F.round(F.sum("v"), 3).alias("total"))


def _line(spark, sf_dir) -> DataFrame:
    return implicit.vector(box_rows(spark, sf_dir).groupBy(F.col("q").alias("i")).agg(F.count("*").alias("v")), 50)


LINE_SQL = "c AS (SELECT range AS i, count(l_quantity) AS c FROM range(50) LEFT JOIN lineitem ON CAST(l_quantity AS INTEGER) - 1 = range GROUP BY ALL)"


@query(
    "cell_non_negative",
    f"WITH {LINE_SQL} SELECT i, round(greatest(0.0, (c + 400.0 * {laplace_sql('one')} + c + 400.0 * {laplace_sql('two')}) / 2), 4) AS v FROM c",
)
def cell_non_negative(spark, sf_dir):
    """Counts by quantity from two noisy answers each, none below 0."""
    x, one = _line(spark, sf_dir), implicit.Identity(50)
    return cells.non_negative([(one, noisy(one, x, 400.0, s), 400.0) for s in ("one", "two")]).select("i", F.round("v", 4).alias("v"))


def _weights_sql(rounds: int) -> str:
    parts = [
        LINE_SQL,
        f"y AS (SELECT i, sum(c) OVER (ORDER BY i) + 3.0 * {laplace_sql('mw')} AS y FROM c)",
        "t AS (SELECT y AS t FROM y WHERE i = 49)",
        "x0 AS (SELECT i, t / 50 AS x FROM y, t)",
    ]
    for k in range(rounds):
        parts.append(f"e{k} AS (SELECT i, x, y - sum(x) OVER (ORDER BY i) AS e FROM x{k} JOIN y USING (i))")
        parts.append(f"m{k} AS (SELECT i, x * exp(sum(e) OVER (ORDER BY i DESC) / (2 * t)) AS x FROM e{k}, t)")
        parts.append(f"x{k + 1} AS (SELECT i, x * t / (SELECT sum(x) FROM m{k}) AS x FROM m{k}, t)")
    return "WITH " + ", ".join(parts) + f" SELECT i, round(x, 4) AS v FROM x{rounds}"


@query("cell_multiplicative_weights", _weights_sql(3))
def cell_multiplicative_weights(spark, sf_dir):
    """Counts by quantity, updated from even ones towards noisy running sums, the total being the last of these."""
    prefix = implicit.Prefix(50)
    y = noisy(prefix, _line(spark, sf_dir), 3.0, "mw")
    even = implicit.ones(spark, 50).crossJoin(F.broadcast(y.where("i = 49").select(F.col("v").alias("t")))).select("i", (F.col("t") / 50).alias("v"))  # one row
    return cells.multiplicative_weights([(prefix, y)], even, 3).select("i", F.round("v", 4).alias("v"))


@query(
    "kronecker_answers",
    f"""WITH {BOX_SQL}, m AS (SELECT range AS mo FROM range(13)), k AS (SELECT range AS q FROM range(50))
    SELECT k.q * 13 + m.mo AS i, CAST(count(enc.q) AS DOUBLE) AS v FROM k CROSS JOIN m LEFT JOIN enc ON enc.q <= k.q AND (enc.mo = m.mo OR m.mo = 12) GROUP BY ALL""",
)
def kronecker_answers(spark, sf_dir):
    """Rows with at most each quantity, by month and for all months."""
    counts = box_rows(spark, sf_dir).groupBy((F.col("q") * 12 + F.col("mo")).alias("i")).agg(F.count("*").alias("v"))
    work = implicit.Kronecker([implicit.Prefix(50), implicit.Stack([implicit.Identity(12), implicit.Total(12)])])
    return work.apply(implicit.vector(counts, 600))


def _factored_sql(rounds: int) -> str:
    """Two groups, each updated by itself from even cells; the answer on one attribute of each is their product."""
    parts = [ITEMS_SQL.strip(), "t AS (SELECT count(*)::DOUBLE AS t FROM enc)"]
    for name, attrs, size in (("g", ("rf", "ls"), 6), ("h", ("qb",), 8)):
        index = "x.range * 2 + y.range" if len(attrs) > 1 else "x.range"
        cells_of = f"range({3 if len(attrs) > 1 else 8}) x" + (", range(2) y" if len(attrs) > 1 else "")
        match = "enc.rf = x.range AND enc.ls = y.range" if len(attrs) > 1 else "enc.qb = x.range"
        parts.append(f"{name}y AS (SELECT x.range AS {attrs[0]}, {index} AS i, (SELECT count(*) FROM enc WHERE {match}) + 5.0 * {laplace_sql(name, '(' + index + ')')} AS y FROM {cells_of})")
        parts.append(f"{name}0 AS (SELECT i, {attrs[0]}, y, t / {size} AS x FROM {name}y, t)")
        for k in range(rounds):
            parts.append(f"{name}m{k} AS (SELECT i, {attrs[0]}, y, x * exp((y - x) / (2 * t)) AS x FROM {name}{k}, t)")
            parts.append(f"{name}{k + 1} AS (SELECT i, {attrs[0]}, y, x * t / (SELECT sum(x) FROM {name}m{k}) AS x FROM {name}m{k}, t)")
    return f"WITH {', '.join(parts)} SELECT rf * 8 + qb AS i, round(sum(g{rounds}.x * h{rounds}.x) / any_value(t), 4) AS v FROM g{rounds}, h{rounds}, t GROUP BY rf, qb"


@query("factored_weights", _factored_sql(3))
def factored_weights(spark, sf_dir):
    """Flags by quantities under independent groups of attributes, each fitted to noisy answers."""
    df = items(spark, sf_dir)
    measured = []
    for q, seed in ((("rf", "ls"), "g"), (("qb",), "h")):
        known = marginals.zero_filled(marginals.dense(df, ITEMS, [q]), ITEMS, [q])
        measured.append((q, known.select(F.col("cell").alias("i"), (F.col("cnt") + 5.0 * keyed_laplace(seed, "cell")).alias("v"))))
    found = cells.FactoredWeights(ITEMS, measured, df.count(), 3)
    return found.answer(("rf", "qb")).select("i", F.round("v", 4).alias("v"))


POWER = 17


def _dyadic_sql(price: float) -> str:
    """Costs and best costs level by level from the cells up, then what is a bucket from the top down."""
    parts = [
        f"h AS (SELECT least({(1 << POWER) - 1}, CAST(floor(l_extendedprice) AS BIGINT)) AS i, count(*) AS c FROM lineitem GROUP BY ALL)",
        f"x AS MATERIALIZED (SELECT range AS i, coalesce(c, 0)::DOUBLE AS v FROM range({1 << POWER}) LEFT JOIN h ON range = i)",
        f"b0 AS MATERIALIZED (SELECT i AS node, TRUE AS alone, {price}::DOUBLE AS best FROM x)",
    ]
    for k in range(1, POWER + 1):
        parts.append(f"c{k} AS (SELECT i >> {k} AS node, sum(abs(v - m)) AS cost FROM x JOIN (SELECT i >> {k} AS p, avg(v) AS m FROM x GROUP BY ALL) ON p = i >> {k} GROUP BY ALL)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT node, cost + {price} <= halves AS alone, least(cost + {price}, halves) AS best FROM c{k} JOIN (SELECT node >> 1 AS node, sum(best) AS halves FROM b{k - 1} GROUP BY ALL) USING (node))")
    parts.append(f"o{POWER} AS (SELECT node, alone FROM b{POWER})")
    for k in reversed(range(POWER)):
        parts.append(f"o{k} AS MATERIALIZED (SELECT b.node, b.alone FROM b{k} b JOIN o{k + 1} o ON b.node >> 1 = o.node AND NOT o.alone)")
    last = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS level, node FROM o{k} WHERE alone" for k in range(POWER + 1))
    return f"WITH {', '.join(parts)} {last}"


@query("dyadic_partition", _dyadic_sql(3.0))
def dyadic_partition(spark, sf_dir):
    """The dyadic buckets of prices of the least cost, without noise."""
    place = F.least(F.lit((1 << POWER) - 1), F.floor(F.col("l_extendedprice")))
    x = implicit.vector(table(spark, sf_dir, "lineitem").groupBy(place.alias("i")).agg(F.count("*").alias("v")), 1 << POWER)
    return dyadic.dyadic_partition(x, 1 << POWER, 3.0)
