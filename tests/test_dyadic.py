"""Dyadic partitions against all partitions, and estimates from them."""

import numpy as np
import pytest

from marginalia.functions.rng import keyed_laplace
from marginalia.plans import dyadic


def cheapest(x, price, cost):
    """The least cost of a range of cells and its buckets, by trying both ways at every node."""

    def go(level, node):
        own = cost(level, node, x[node << level : (node + 1) << level]) + price
        if not level:
            return own, [(0, node)]
        a, b = go(level - 1, 2 * node), go(level - 1, 2 * node + 1)
        return (own, [(level, node)]) if own <= a[0] + b[0] else (a[0] + b[0], a[1] + b[1])

    return go(len(x).bit_length() - 1, 0)


def line(spark, x):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double").repartition(3)


@pytest.mark.parametrize("block, scale", [(12, 0.0), (3, 0.0), (2, 4.0)])
def test_partition_equals_brute_force(spark, block, scale):
    rng = np.random.default_rng(block)
    x = np.repeat(rng.integers(0, 40, 16), 4) + rng.integers(0, 3, 64)

    def cost(level, node, part):
        spread = np.abs(part - part.mean()).sum()
        return max(spread + scale * dyadic._laplace("7", level, np.array([node]))[0], 0.0) if level and scale else spread

    found = dyadic.dyadic_partition(line(spark, x), 64, 5.0, scale, 7, block)
    assert sorted(tuple(r) for r in found.collect()) == sorted(cheapest(x, 5.0, cost)[1])


def test_noise_is_that_of_columns(spark):
    rows = spark.range(20).selectExpr("CAST(id % 3 AS INT) AS level", "id AS node").withColumn("l", keyed_laplace("s", "level", "node")).collect()
    assert all(r.l == pytest.approx(dyadic._laplace("s", r.level, np.array([r.node]))[0]) for r in rows)


def test_single_cells_and_one_bucket(spark):
    assert [tuple(r) for r in dyadic.dyadic_partition(line(spark, [3.0] * 8), 8, 1.0, block=1).collect()] == [(3, 0)]
    assert dyadic.dyadic_partition(line(spark, [0, 50, 0, 50]), 4, 1.0).count() == 4
    assert [tuple(r) for r in dyadic.dyadic_partition(line(spark, [9.0]), 1, 1.0).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        dyadic.dyadic_partition(line(spark, [1, 2, 3]), 3, 1.0)


def test_estimates_on_a_grid(spark):
    """Large budgets give the counts back; what is even costs one bucket."""
    x = np.zeros((8, 8))
    x[:4, :4], x[5, 6] = 100, 300
    grid = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "x int, y int, cnt double")
    got = np.zeros((8, 8))
    for r in dyadic.dawa_2d(grid, 8, 1000.0, 3).collect():
        got[r.x, r.y] = r.v
    assert np.abs(got - x).max() < 2
