"""Operators that are never written out against the matrices that they stand for, and inference over tables of cells."""

import numpy as np
import pytest

from marginalia.operators import implicit, matrix
from marginalia.plans import cells, inference, linear


def table(spark, x):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double").repartition(3)


def array(df, n):
    out = np.full(n, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.i])
        out[r.i] = r.v
    return out


def spans(spark, rows):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "i long, low long, high long")


def tree_matrix(n, b):
    return np.array([[1.0 if c // b**k == node else 0.0 for c in range(n)] for k in range(len(implicit.Tree(n, b).sizes)) for node in range(implicit.Tree(n, b).sizes[k])])


RANGES = [(0, 0), (2, 4), (0, 4), (4, 4), (1, 2)]
RANGE_MATRIX = np.array([[1.0 if a <= c <= b else 0.0 for c in range(5)] for a, b in RANGES])
BOX_MATRIX = np.array([np.outer(np.outer([1, 1], [0, 1, 1]), [1, 0]).ravel(), np.outer(np.outer([0, 1], [1, 1, 1]), [1, 1]).ravel()], dtype=float)
ENTRIES = np.array([[0, -2.0, 0, 0], [0, 0, 0, 0], [1, 0, 0, 3]])


def cases(spark):
    I, P, T, R = implicit.Identity(3), implicit.Prefix(4), implicit.Total(3), implicit.Ranges(spans(spark, RANGES), 5, 5)
    entries = implicit.Entries(spark.createDataFrame([(int(q), int(c), float(ENTRIES[q, c])) for q, c in zip(*ENTRIES.nonzero())], "q long, cell long, val double"), 3, 4)
    prefix, total = np.tril(np.ones((4, 4))), np.ones((1, 3))
    return {
        "identity": (I, np.eye(3)),
        "total": (T, total),
        "prefix": (P, prefix),
        "ranges": (R, RANGE_MATRIX),
        "tree": (implicit.Tree(7, 3), tree_matrix(7, 3)),
        "blocks": (implicit.Blocks(7, 3), tree_matrix(7, 3)[7:10]),
        "boxes": (implicit.Boxes(spark.createDataFrame([(0, 0, 1, 1, 2, 0, 0), (1, 1, 1, 0, 2, 0, 1)], "i long, low0 int, high0 int, low1 int, high1 int, low2 int, high2 int"), 2, [2, 3, 2]), BOX_MATRIX),
        "box tree": (implicit.box_tree([3, 2]), np.concatenate([np.eye(6), [[1, 1, 1, 1, 0, 0], [0, 0, 0, 0, 1, 1]], np.ones((1, 6))])),
        "haar": (implicit.Haar(8), linear.haar_matrix(8)),
        "entries": (entries, ENTRIES),
        "weighted": (implicit.Weighted(entries, -0.5), -0.5 * ENTRIES),
        "stack": (implicit.Stack([P, entries]), np.concatenate([prefix, ENTRIES])),
        "beside": (implicit.beside([T, implicit.Total(2)]), np.ones((1, 5))),
        "sum": (implicit.Sum([I, implicit.Product(implicit.Transposed(T), T)]), np.eye(3) + np.ones((3, 3))),
        "product": (implicit.Product(T, implicit.Prefix(3)), total @ np.tril(np.ones((3, 3)))),
        "transposed": (implicit.Transposed(P), prefix.T),
        "kronecker": (implicit.Kronecker([R, T, P]), np.kron(np.kron(RANGE_MATRIX, total), prefix)),
        "kronecker of stacks": (implicit.Kronecker([implicit.Stack([P, entries]), implicit.Tree(3, 2)]), np.kron(np.concatenate([prefix, ENTRIES]), tree_matrix(3, 2))),
        "nested": (implicit.Kronecker([implicit.Kronecker([I, implicit.Haar(2)]), implicit.Total(2)]), np.kron(np.kron(np.eye(3), linear.haar_matrix(2)), np.ones((1, 2)))),
    }


NAMES = ["blocks", "boxes", "box tree", "identity", "total", "prefix", "ranges", "tree", "haar", "entries", "weighted", "stack", "beside", "sum", "product", "transposed", "kronecker", "kronecker of stacks", "nested"]


@pytest.mark.parametrize("name", NAMES)
def test_operators_equal_their_matrices(spark, name):
    op, dense = cases(spark)[name]
    rng = np.random.default_rng(1)
    assert (op.rows, op.columns) == dense.shape
    x, y = rng.normal(size=op.columns), rng.normal(size=op.rows)
    np.testing.assert_allclose(array(op.apply(table(spark, x)), op.rows), dense @ x, atol=1e-12)
    np.testing.assert_allclose(array(op.adjoint(table(spark, y)), op.columns), dense.T @ y, atol=1e-12)
    assert op.sensitivity(spark) == pytest.approx(np.abs(dense).sum(axis=0).max())


def test_cancelling_entries_are_refused(spark):
    with pytest.raises(NotImplementedError):
        implicit.Product(implicit.Haar(4), implicit.Haar(4)).absolute()
    with pytest.raises(ValueError):
        implicit.Stack([implicit.Total(3), implicit.Total(4)])


def test_entries_that_are_their_own_absolutes():
    own = implicit.Kronecker([implicit.Stack([implicit.Prefix(4), implicit.Weighted(implicit.Total(4), 0.5)]), implicit.Tree(3)])
    assert own.absolute() is own and implicit.Product(implicit.Total(own.rows), own).absolute().left.columns == own.rows
    assert implicit.Weighted(implicit.Total(4), -1).absolute().weight == 1


def test_running_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(implicit, "STRIDE", 4)
    x = np.arange(50.0)
    np.testing.assert_allclose(array(implicit.Prefix(50).apply(table(spark, x)), 50), np.cumsum(x))
    np.testing.assert_allclose(array(implicit.Prefix(50).adjoint(table(spark, x)), 50), np.cumsum(x[::-1])[::-1])
    np.testing.assert_allclose(array(implicit.Total(50).adjoint(table(spark, [2.0])), 50), np.full(50, 2.0))


def test_entries_are_those_of_matrix_tables(spark):
    entries = matrix.kronecker(matrix.prefix(spark, 3), matrix.identity(spark, 2), 2, 2)
    both = implicit.Kronecker([implicit.Prefix(3), implicit.Identity(2)])
    x = table(spark, range(6))
    np.testing.assert_allclose(array(implicit.Entries(entries, 6, 6).apply(x), 6), array(both.apply(x), 6))


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    op, dense = implicit.Kronecker([implicit.Haar(2), implicit.Prefix(2)]), np.kron(linear.haar_matrix(2), np.tril(np.ones((2, 2))))
    x = rng.normal(size=4)
    y = [dense @ x + rng.normal(size=4), x + rng.normal(size=4)]
    parts = [(op, table(spark, y[0]), 2.0), (implicit.Identity(4), table(spark, y[1]), 0.5)]
    want = inference.least_squares([(dense, y[0], 2.0), (np.eye(4), y[1], 0.5)])
    np.testing.assert_allclose(array(cells.least_squares(parts), 4), want, atol=1e-8)


def test_least_squares_of_too_few_answers_is_the_smallest(spark):
    op, dense = implicit.Ranges(spans(spark, RANGES[:3]), 3, 5), RANGE_MATRIX[:3]
    y = np.array([1.0, 4.0, 7.0])
    np.testing.assert_allclose(array(cells.least_squares([(op, table(spark, y), 1.0)]), 5), np.linalg.pinv(dense) @ y, atol=1e-9)
    zero = cells.least_squares([(op, table(spark, [0.0] * 3), 1.0)])
    assert array(zero, 5).tolist() == [0.0] * 5


def test_non_negative(spark):
    dense, op = tree_matrix(4, 2), implicit.Tree(4, 2)
    y = dense @ np.array([5, 0, 0, 9.0]) + np.array([0, -2, -3, 1, 2, 0, -1])
    found = array(cells.non_negative([(op, table(spark, y), 1.0)], rounds=40, tolerance=1e-4), 4)
    want = inference.non_negative([(dense, y, 1.0)])
    assert found.min() == 0 == want.min()
    np.testing.assert_allclose(found, want, atol=1e-2)


def test_workload_non_negative(spark):
    y = np.array([4.0, -1.0, 2.0, -0.5])
    found = array(cells.workload_non_negative(implicit.Identity(4), [(implicit.Identity(4), table(spark, y), 1.0)]), 4)
    np.testing.assert_allclose(found, np.maximum(y, 0), atol=1e-9)


def test_multiplicative_weights(spark):
    x = np.array([1.0, 2, 3, 4])
    y = np.tril(np.ones((4, 4))) @ np.array([4.0, 3, 2, 1])
    want = x.copy()
    for _ in range(3):
        want = want * np.exp(np.tril(np.ones((4, 4))).T @ (y - np.cumsum(want)) / 20)
        want *= 10 / want.sum()
    found = cells.multiplicative_weights([(implicit.Prefix(4), table(spark, y))], table(spark, x), 3)
    np.testing.assert_allclose(array(found, 4), want, rtol=1e-12)


def test_box_trees_leave_out_root_or_cells(spark):
    assert [p.rows for p in implicit.box_tree([4, 4], root=False).parts] == [16, 4]
    assert [p.rows for p in implicit.box_tree([4, 2], leaves=False).parts] == [2, 1]
    assert implicit.box_tree([3, 5, 1], 3).sensitivity(spark) == 3.0
