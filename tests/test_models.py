"""Answers of graphical models, best rows and adaptive grids against brute force over all cells."""

from itertools import combinations, product

import numpy as np
import pytest

from marginalia.domain import Domain
from marginalia.operators import workload
from marginalia.plans import adaptive, approximate, cells, inference, pgm, regions, strategy

D = Domain.of({"a": 2, "b": 3, "c": 4, "d": 2, "e": 3})


def model(cliques, seed=0, domain=D):
    rng = np.random.default_rng(seed)
    found = pgm.GraphicalModel(domain, cliques, 100.0)
    found.potentials = {q: pgm.Factor(f.domain, rng.normal(size=f.values.shape)) for q, f in found.potentials.items()}
    found.marginals = found.belief_propagation(found.potentials)
    return found


def whole(m):
    """The counts of all cells, from the potentials."""
    logs = np.zeros(m.domain.shape)
    for q, f in m.potentials.items():
        logs = logs + f.expand(m.domain)
    p = np.exp(logs)
    return p * m.total / p.sum()


CLIQUES = [[("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], [("a", "b"), ("a", "c"), ("a", "d", "e")], [("a", "b"), ("c", "d")], [("a", "b", "c"), ("b", "c", "d"), ("c", "d", "e")], [("a",), ("b",)]]


@pytest.mark.parametrize("cliques", CLIQUES)
def test_many_marginals(cliques):
    m = model(cliques)
    p = whole(m)
    queries = [q for k in (1, 2, 3, 5) for q in combinations(D.attrs, k)] + [("e", "a"), ("d", "b", "a")]
    for q, f in m.many(queries).items():
        assert f.domain.attrs == q
        want = pgm.Factor(D, p).project(q).values
        np.testing.assert_allclose(f.values, want, rtol=1e-9)


@pytest.mark.parametrize("cliques", CLIQUES)
def test_kronecker_answers(cliques):
    m, rng = model(cliques, 1), np.random.default_rng(2)
    matrices = {a: rng.normal(size=(k, D[a])) for a, k in (("d", 2), ("a", 1), ("c", 3))}
    p = pgm.Factor(D, whole(m)).project(("d", "a", "c")).values
    want = np.einsum("dac,xd,ya,zc->xyz", p, matrices["d"], matrices["a"], matrices["c"])
    np.testing.assert_allclose(m.kronecker(matrices), want, rtol=1e-9)


def test_closed_form_fit():
    cliques = CLIQUES[0]
    p = np.random.default_rng(3).integers(0, 5, D.shape).astype(float)
    p[0] = 0  # a value without rows
    m = pgm.GraphicalModel(D, cliques)
    m.fit({q: pgm.Factor(D, p).project(q).flat() for q in m.cliques})
    assert m.total == p.sum()
    for q in cliques:
        np.testing.assert_allclose(m.project(q).values, pgm.Factor(D, p).project(q).values, atol=1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_most_likely_row(seed):
    rng = np.random.default_rng(seed)
    queries = [q for k in (1, 2, 3) for q in combinations(D.attrs, k)]
    some = [queries[k] for k in rng.choice(len(queries), 5, replace=False)]
    factors = [pgm.Factor(D.project(q), rng.normal(size=D.project(q).shape)) for q in some]
    total = sum(f.expand(D) for f in factors) + np.zeros(D.shape)
    row, value = pgm.most_likely(factors, D)
    assert value == pytest.approx(total.max()) == pytest.approx(total[tuple(row[a] for a in D.attrs)])


def test_best_response_of_picked_queries():
    names = [(q, c) for q in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")) for c in range(D.size(q))]
    rng = np.random.default_rng(5)
    for _ in range(10):
        picked = rng.integers(0, 2 * len(names), 15)

        def value(row):
            out = 0
            for k in picked:
                q, c = names[k % len(names)]
                hit = np.ravel_multi_index([row[D.attrs.index(a)] for a in q], D.project(q).shape) == c
                out += (1 if k < len(names) else -1) * hit
            return out

        row, found = approximate.best_response(picked, names, D)
        assert found == value(row) == max(map(value, product(*map(range, D.shape))))


SMALL = Domain.of({"x": 3, "y": 4, "z": 2})


def by_hand(counts, queries, least):
    """Rows of adaptive grids as vectors over the cells of each set: {query: {(part, cell): vector}}."""
    grids, high = {}, {}
    for q in sorted(queries, key=len):
        below = [c for c in combinations(q, len(q) - 1) if c in grids]
        shape = SMALL.project(q).shape
        rows, cells = {}, list(product(*map(range, shape)))
        drop = lambda x, c: tuple(v for a, v in zip(q, x) if a in c)
        good = [all(drop(x, c) in high[c] for c in below) for x in cells]
        for x, ok in zip(cells, good):
            if ok:
                rows["", int(np.ravel_multi_index(x, shape))] = np.array([float(y == x) for y in cells])
        for c in below:
            for (part, at), vector in grids[c].items():
                own = SMALL.project(c).shape
                wide = np.array([0.0 if ok else vector[np.ravel_multi_index(drop(x, c), own)] for x, ok in zip(cells, good)])
                rows[",".join(c) + (">" + part if part else ""), at] = wide / np.sqrt(len(below))
        grids[q] = rows
        x = counts.sum(axis=tuple(k for k, a in enumerate(SMALL.attrs) if a not in q)).ravel()
        high[q] = {cells[at] for (part, at), v in rows.items() if part == "" and v @ x >= least}
    return grids


@pytest.mark.parametrize("queries", [workload.closure([("x", "y", "z")]), [("x",), ("y",), ("x", "y", "z")], [("x", "y"), ("z",), ("y", "z")]])
def test_adaptive_grid_rows(spark, queries):
    rng = np.random.default_rng(7)
    counts = np.where(rng.random(SMALL.shape) < 0.4, 0, rng.integers(1, 9, SMALL.shape))
    rows = [(*map(int, x), 1) for x, n in np.ndenumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "x int, y int, z int, v int")
    grids, found = adaptive.measured(df, SMALL, queries, 0.0, 15)
    want = by_hand(counts, queries, 15)
    for q, frame in found.items():
        x = counts.sum(axis=tuple(k for k, a in enumerate(SMALL.attrs) if a not in q)).ravel()
        got = {(r.part, r.cell): r.v for r in frame.collect()}
        assert got.keys() == want[q].keys()
        for key, vector in want[q].items():
            assert got[key] == pytest.approx(vector @ x)
        matrix, y = grids.matrix(q, frame)
        np.testing.assert_allclose(matrix, np.array([want[q][k] for k in sorted(want[q])]))
        assert np.sqrt((matrix**2).sum(axis=0)).max() <= 1 + 1e-12


def test_adaptive_grid_mechanism(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, 4000)
    y, z = (x + rng.integers(0, 2, 4000)) % 4, (rng.random(4000) < 0.2 + 0.3 * x).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), z.tolist())), "x int, y int, z int")
    found = adaptive.adaptive_grid(df, SMALL, 10.0, 1e-6, targets=["z"], seed=3, iterations=300)
    assert found.chosen == [("x", "y", "z")] and found.ledger.spent <= found.ledger.rho * (1 + 1e-9)
    truth = np.zeros(SMALL.shape)
    np.add.at(truth, (x, y, z), 1)
    assert np.abs(found.model.project(("x", "y", "z")).values - truth).sum() / 4000 < 0.08
    again = adaptive.adaptive_grid(df, SMALL, 10.0, 1e-6, targets=["z"], seed=3, iterations=300)
    np.testing.assert_allclose(again.model.datavector(), found.model.datavector())


def measurements(seed=9):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 30, D.shape).astype(float)
    truth[0, 1] = 0
    truth[:, 2, :, 1] = 0
    found = [pgm.Measurement(q, pgm.Factor(D, truth).project(q).flat() + rng.normal(0, 20, D.size(q)), 20.0) for q in CLIQUES[0]]
    return [*found, pgm.Measurement(("a", "c"), pgm.Factor(D, truth).project(("a", "c")).flat()[:3], 5.0, np.eye(8)[:3])]


@pytest.mark.parametrize("method, rounds", [("dual", 400), ("interior", 400)])
def test_other_estimators_fit_as_well(method, rounds):
    parts, losses = measurements(), []
    best = pgm.estimate(D, parts, iterations=2000)
    found = pgm.estimate(D, parts, iterations=rounds, method=method, callback=lambda t, loss: losses.append(loss))
    loss = lambda m: pgm.loss_and_gradient(m, m.marginals, parts)[0]
    assert loss(found) <= loss(best) * 1.01 + 1e-6 and len(losses) == rounds
    assert found.datavector().sum() == pytest.approx(best.total)
    with pytest.raises(ValueError):
        pgm.estimate(D, parts, method=method, metric="L1")


@pytest.mark.parametrize("method", ["mirror", "dual", "interior"])
def test_forbidden_cells_get_no_mass(method):
    parts = measurements()
    zeros = {("a", "b"): [(0, 1)], ("b", "d"): [(2, 1)], ("e",): []}
    m = pgm.estimate(D, parts, iterations=200, method=method, zeros=zeros)
    assert m.project(("a", "b")).values[0, 1] == 0 and m.project(("b", "d")).values[2, 1] == 0
    assert np.isfinite(m.datavector()).all() and m.datavector().sum() == pytest.approx(m.total)
    again = pgm.estimate(D, parts, iterations=50, warm=m, zeros=zeros)
    assert again.project(("b", "d")).values[2, 1] == 0


def spread(spark, graph, factors):
    """Potentials of cliques as a table, each on the first region that has its attributes."""
    rows = []
    for q, f in factors.items():
        r = next(k for k, x in enumerate(graph.regions) if set(q) <= set(x))
        wide = (f.expand(D.project(graph.regions[r])) + np.zeros(D.project(graph.regions[r]).shape)).ravel()
        rows += [(r, k, float(v)) for k, v in enumerate(wide)]
    return spark.createDataFrame(rows, "region int, cell bigint, v double").groupBy("region", "cell").sum("v").withColumnRenamed("sum(v)", "theta")


def beliefs(found, graph):
    out = [np.zeros(D.size(q)) for q in graph.regions]
    for r in found.collect():
        out[r.region][r.cell] = r.v
    return [pgm.Factor(D.project(q), v.reshape(D.project(q).shape)) for q, v in zip(graph.regions, out)]


@pytest.mark.parametrize("cliques", [CLIQUES[0], CLIQUES[3]])
def test_region_propagation_is_exact_on_a_tree(spark, cliques):
    m = model(cliques, 4)
    p = pgm.Factor(D, whole(m))
    graph = regions.RegionGraph.junction(D, cliques)
    found = beliefs(regions.propagate(graph, spread(spark, graph, m.potentials), m.total, rounds=8), graph)
    for f in found:
        np.testing.assert_allclose(f.values, p.project(f.domain.attrs).values, rtol=1e-6)


LOOP = [("a", "b"), ("b", "c"), ("a", "c")]


def test_region_propagation_on_a_loop(spark):
    """Counting numbers of spanning trees: regions agree, and marginals are within 20 % of the total of the exact ones, where
    potentials are of about 0.5."""
    rng = np.random.default_rng(6)
    factors = {q: pgm.Factor(D.project(q), rng.normal(size=D.project(q).shape) * 0.5) for q in LOOP}
    logs = sum(f.expand(D) for f in factors.values()) + np.zeros(D.shape)
    exact = pgm.Factor(D, np.exp(logs) / np.exp(logs).sum())
    graph = regions.RegionGraph.lattice(D, LOOP, 2 / 3)
    assert len(graph.regions) == 6 and len(graph.edges) == 6
    found = beliefs(regions.propagate(graph, spread(spark, graph, factors), rounds=25, damping=0.3, tolerance=1e-4), graph)
    assert graph.counting == pytest.approx([2 / 3] * 3 + [-1 / 3] * 3)
    for p, r in graph.edges:
        np.testing.assert_allclose(found[p].project(found[r].domain.attrs).values, found[r].values, atol=2e-3)
    for f in found:
        assert np.abs(f.values - exact.project(f.domain.attrs).values).sum() < 0.2


def test_region_graphs():
    graph = regions.RegionGraph.bethe(D, [("a", "b"), ("b", "c")])
    assert graph.counting == [1, 1, 0, -1, 0] and len(graph.edges) == 4
    deep = regions.RegionGraph.lattice(D, [("a", "b", "c"), ("b", "c", "d"), ("b", "e")])
    assert set(deep.regions) == {("a", "b", "c"), ("b", "c", "d"), ("b", "e"), ("b", "c"), ("b",)}
    assert {(deep.regions[p], deep.regions[r]) for p, r in deep.edges} == {(("a", "b", "c"), ("b", "c")), (("b", "c", "d"), ("b", "c")), (("b", "c"), ("b",)), (("b", "e"), ("b",))}
    with pytest.raises(ValueError):
        regions.propagate(regions.RegionGraph(D, [("a", "b"), ("a",)], [(0, 1)], [-1.0, 1.0]), _nothing())


def _nothing():
    class Table:
        sparkSession = None

    return Table()


def test_errors_of_strategies_equal_those_of_matrices():
    work = {("a", "b"): 1.0, ("b", "c"): 2.0, ("c",): 1.0}
    small = Domain.of({"a": 3, "b": 4, "c": 2})
    measured = [q for k in range(4) for q in combinations(small.attrs, k)]
    key = lambda q: sum(1 << k for k, a in enumerate(small.attrs) if a in q)
    error = strategy.Error(small, work, measured)
    rng = np.random.default_rng(0)
    asked = np.zeros(8)
    for q, w in work.items():
        asked[key(q)] = w
    for _ in range(5):
        u, weights = rng.random(8), np.zeros(8)
        for q, x in zip(measured, u):
            weights[key(q)] = np.sqrt(x)
        a, w = inference.marginal_gram(small.shape, weights), inference.marginal_gram(small.shape, asked)
        assert error(u) == pytest.approx(u.sum() * np.trace(np.linalg.pinv(a) @ w))


def test_best_strategy():
    error = strategy.Error(D, dict.fromkeys(workload.k_way(D.attrs, 2), 1.0), workload.closure(workload.k_way(D.attrs, 3)))
    best = error.best()
    assert best.sum() == pytest.approx(1) and best.min() >= 0
    rng = np.random.default_rng(1)
    others = [error(rng.dirichlet(np.full(len(best), 0.3))) for _ in range(500)]
    even = [error(np.array([float(len(q) == k) for q in error.measured])) for k in (2, 3)]
    assert error(best) <= min(*others, *even) * (1 + 1e-9)
    identity = strategy.Error(D, dict.fromkeys(workload.k_way(D.attrs, 2), 1.0), [D.attrs])
    assert error(best) < identity(np.ones(1))
    near = best * np.exp(rng.normal(0, 1e-3, len(best)))
    assert error(near) >= error(best) * (1 - 1e-9)
    with pytest.raises(ValueError):
        strategy.Error(D, {("a", "b"): 1.0}, [("a",), ("b",)])


def test_optimised_mechanism(spark):
    x = np.random.default_rng(2).integers(0, 3, 3000)
    df = spark.createDataFrame([(int(v), int(v + k % 2), int(v > 0)) for k, v in enumerate(x)], "x int, y int, z int")
    found = strategy.optimised(df, SMALL, [("x", "y"), ("y", "z")], 5.0, 1e-6, seed=1, iterations=300)
    assert found.ledger.spent <= found.ledger.rho * (1 + 1e-9) and ("x", "y") in found.chosen
    truth = np.zeros((3, 4))
    np.add.at(truth, (x, x + np.arange(3000) % 2), 1)
    assert np.abs(found.model.project(("x", "y")).values - truth).sum() < 150


def test_factored_weights(spark):
    """One group: plain multiplicative weights; two: the product; an attribute that nothing measures: even."""
    rng = np.random.default_rng(3)
    small = Domain.of({"x": 2, "y": 3, "z": 2, "w": 2})
    table = lambda v: spark.createDataFrame([(k, float(n)) for k, n in enumerate(v)], "i long, v double")
    ab, bz = rng.integers(5, 30, 6).astype(float), rng.integers(5, 30, 6).astype(float)
    measured = [(("y", "x"), table(ab)), (("y", "z"), table(bz))]
    found = cells.FactoredWeights(small, measured, 100.0, 2)
    assert found.groups == [("x", "y", "z")]
    p = np.full((2, 3, 2), 100 / 12)
    for _ in range(2):
        lack_ab, lack_bz = ab.reshape(3, 2) - p.sum(axis=2).T, bz.reshape(3, 2) - p.sum(axis=0)
        p = p * np.exp((lack_ab.T[:, :, None] + lack_bz[None]) / 200)
        p *= 100 / p.sum()
    got = {r.i: r.v for r in found.answer(("z", "x", "w")).collect()}
    want = np.einsum("xyz,w->zxw", p, np.full(2, 0.5)).ravel()
    np.testing.assert_allclose([got[k] for k in range(8)], want, rtol=1e-9)
