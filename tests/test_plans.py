import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators import marginals, workload
from marginalia.plans import accounting, inference, linear, mechanisms, pgm, sweep, synth

D = Domain.of({"a": 2, "b": 3, "c": 2, "d": 4})


@pytest.fixture(scope="module")
def table(spark):
    u = lambda k: F.rand(k)
    base = spark.range(6000).select((u(1) < 0.3).cast("int").alias("a"), F.floor(u(2) * 3).cast("int").alias("_b"), u(3).alias("_u"), F.floor(u(4) * 4).cast("int").alias("d"))
    out = base.select("a", F.when(F.col("_u") < 0.7, F.col("a")).otherwise(F.col("_b")).alias("b"), "d").withColumn("c", F.when(F.col("b") == 2, 1).otherwise(F.col("a")))
    return out.select("a", "b", "c", "d").persist()


# -- accounting ------------------------------------------------------------------------------


def test_zcdp_round_trip():
    for eps, delta in ((0.5, 1e-6), (1.0, 1e-5), (3.0, 1e-9)):
        rho = accounting.cdp_rho(eps, delta)
        assert math.isclose(accounting.cdp_eps(rho, delta), eps, rel_tol=1e-6)
        assert math.isclose(accounting.cdp_delta(rho, eps), delta, rel_tol=1e-3)
    assert accounting.cdp_delta(0, 1) == 0 and accounting.cdp_eps(0, 1e-5) == 0


def test_ledger_spends_the_whole_budget():
    ledger = accounting.Ledger(1.0, 1e-5)
    share = ledger.rho / 8
    for _ in range(5):
        ledger.gaussian(accounting.gaussian_sigma(share))
    for _ in range(3):
        ledger.exponential(accounting.exponential_epsilon(share))
    assert round(ledger.eps_spent, 3) == 1
    with pytest.raises(accounting.BudgetExceeded):
        ledger.laplace(1.0)
    assert math.isclose(accounting.laplace_cost(accounting.laplace_scale(0.1)), 0.1)


def test_subsampled_gaussian():
    assert math.isclose(accounting.subsampled_gaussian_rdp(1.0, 2.0, 8), 1.0)
    direct = math.log(sum(math.comb(3, k) * 0.9 ** (3 - k) * 0.1**k * math.exp(k * (k - 1) / 2) for k in range(4))) / 2
    assert math.isclose(accounting.subsampled_gaussian_rdp(0.1, 1.0, 3), direct)
    sigma = accounting.sampled_gaussian_sigma(0.1, 100, 2.0, 1e-5)
    assert 1.98 < accounting.sampled_gaussian_eps(0.1, sigma, 100, 1e-5) <= 2.0


def test_budget_tree():
    root = accounting.BudgetNode(1.0)
    doubled = root.derive(2.0)
    doubled.request(0.2)
    assert math.isclose(root.spent, 0.4)
    parts = root.partition(3)
    parts[0].request(0.3)
    parts[1].request(0.5)
    parts[2].request(0.1)
    assert math.isclose(root.spent, 0.9)
    parts[0].request(0.2)
    assert math.isclose(root.spent, 0.9)
    with pytest.raises(accounting.BudgetExceeded):
        doubled.request(0.1)
    assert math.isclose(root.spent, 0.9)


def test_protected_frame(spark, table):
    protected = accounting.Protected.of(table, 1.0, "seed")
    noisy = protected.where("a = 1").laplace(D, ("b",), 0.5)
    assert noisy.count() == 3 and protected.node.spent == 0.5
    for part in protected.split_by("a", [0, 1]):
        part.project(["b", "c"]).laplace(D, ("c",), 0.5)
    with pytest.raises(accounting.BudgetExceeded):
        protected.laplace(D, ("d",), 0.1)


def test_no_two_measurements_share_noise(spark, table):
    """The same cells of derived tables, of parts and of the root each get a draw of their own."""
    root = accounting.Protected.of(table, 100.0, "seed")
    places = [root, root, root.where("true"), root.where("true").where("true"), root.project(["a", "b", "c", "d"]), *root.split_by("a", [0, 0])]
    true = {r.cell: r.cnt for r in marginals.zero_filled(marginals.marginals(table, D, [("b",)]), D, [("b",)]).collect()}
    part = {r.cell: r.cnt for r in marginals.zero_filled(marginals.marginals(table.where("a = 0"), D, [("b",)]), D, [("b",)]).collect()}
    noise = [[r.noisy - (part if k >= 5 else true)[r.cell] for r in p.laplace(D, ("b",), 0.5).collect()] for k, p in enumerate(places)]
    drawn = [round(x, 9) for row in noise for x in row]
    assert len(set(drawn)) == len(drawn)


def test_empty_cohort_takes_no_part(spark, table):
    held = table.withColumn("client", F.lit(1))
    seen = []

    def watch(truth, *rest, **options):
        seen.append(truth(0))
        raise StopIteration

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mechanisms, "aim_loop", watch)
        with pytest.raises(StopIteration):
            mechanisms.distributed_aim(held, "client", D, [("a", "b")], 1.0, 1e-6, q=1e-12, seed=1)
    known, scale = seen[0]
    assert scale == 2.0 and all(not v.any() for v in known.values())


# -- graphical models --------------------------------------------------------------------------


def joint(model):
    total = pgm.Factor.zeros(model.domain)
    for f in model.potentials.values():
        total = total + f
    values = np.exp(total.project(model.domain.attrs).values if total.domain.attrs != model.domain.attrs else total.values)
    return values * model.total / values.sum()


@pytest.mark.parametrize("cliques", [[("a", "b"), ("b", "c"), ("c", "d")], [("a", "b"), ("b", "c"), ("a", "c"), ("d",)], [("a", "b"), ("b", "d"), ("d", "c"), ("c", "a")]])
def test_propagation_and_elimination_against_the_joint(cliques):
    rng = np.random.default_rng(1)
    model = pgm.GraphicalModel(D, cliques, 50.0)
    for q in model.cliques:
        model.potentials[q] = pgm.Factor(D.project(q), rng.normal(size=D.project(q).shape))
    model.marginals = model.belief_propagation(model.potentials)
    whole = pgm.Factor(D, joint(model))
    for k in (1, 2, 3):
        for q in itertools.permutations(D.attrs, k):
            assert np.allclose(model.project(q).values, whole.project(q).values)
    assert math.isclose(model.datavector().sum(), 50.0)
    seen = set()
    for attr, parents, shares in model.conditionals():
        assert set(parents) <= seen and np.allclose(shares.sum(axis=-1), 1)
        seen.add(attr)
    assert seen == set(D.attrs)


def test_junction_tree_keeps_running_intersection():
    tree = pgm.JunctionTree(D, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert all(any(set(q) <= set(c) for c in tree.cliques) for q in [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    assert len(tree.edges) == len(tree.cliques) - 1
    assert tree.megabytes() > 0


def test_factor_algebra():
    rng = np.random.default_rng(0)
    f, g = pgm.Factor(D.project(["a", "b"]), rng.random((2, 3))), pgm.Factor(D.project(["c", "b"]), rng.random((2, 3)))
    assert np.allclose((f * g).values, f.values[:, :, None] * g.values.T[None])
    assert np.allclose(((f * g) / g).sum(["a", "b"]).values, 2 * f.values)
    assert np.allclose(f.log().logsumexp(["a"]).exp().values, f.values.sum(axis=1))
    assert np.allclose(f.condition({"b": 1}).values, f.values[:, 1]) and f.max(["b"]).values.shape == (3,)
    low = pgm.Factor(D.project(["a"]), np.array([-np.inf, 1.0]))
    assert np.isfinite((f - low).values).all()


def test_estimate_recovers_consistent_marginals():
    rng = np.random.default_rng(2)
    p = rng.random(D.shape)
    p = p / p.sum() * 1000
    truth = pgm.Factor(D, p)
    cliques = [("a", "b"), ("b", "c"), ("c", "d")]
    measured = [pgm.Measurement(q, truth.project(q).flat(), 1.0) for q in cliques]
    losses = []
    model = pgm.estimate(D, measured, iterations=3000, callback=lambda t, loss: losses.append(loss))
    assert math.isclose(model.total, 1000, rel_tol=1e-9) and losses == sorted(losses, reverse=True)
    for m in measured:
        assert np.abs(model.project(m.query).flat() - m.y).sum() < 2
    q = np.tril(np.ones((4, 4)))
    prefix = pgm.Measurement(("d",), q @ truth.project(("d",)).flat(), 1.0, q)
    assert math.isclose(pgm.estimate_total([prefix]), 1000, rel_tol=1e-6)
    fitted = pgm.estimate(D, [prefix], iterations=2000)
    assert np.abs(fitted.project(("d",)).flat() - truth.project(("d",)).flat()).sum() < 5


def test_rows_follow_the_model(spark):
    rng = np.random.default_rng(3)
    p = pgm.Factor(D, rng.random(D.shape))
    cliques = [("a", "b"), ("b", "c"), ("c", "d")]
    model = pgm.estimate(D, [pgm.Measurement(q, p.project(q).flat() * 1000, 1.0) for q in cliques], iterations=500)
    rows = synth.rows(spark, model, 5000, seed=1)
    assert rows.columns == list(D.attrs) and rows.count() == 5000
    assert rows.collect() == synth.rows(spark, model, 5000, seed=1).collect()
    found = mechanisms.answers(marginals.dense(rows, D, cliques), D, cliques)
    for q in cliques:
        want = model.project(q).flat() / model.total * 5000
        assert np.abs(found[q] - want).max() < 12
    assert synth.rows(spark, model, 0).count() == 0


def test_chunks_still_follow_the_model(spark, monkeypatch):
    monkeypatch.setattr(synth, "CHUNK", 500)
    model = pgm.estimate(D, [pgm.Measurement(("a",), np.array([300.0, 700.0]), 1.0)], iterations=300)
    assert abs(synth.rows(spark, model, 4100, 2).where("a = 1").count() - 2870) <= 9
    assert synth.rows(spark, model, 4100, 2).count() == 4100


# -- mechanisms ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["aim", "random_aim", "mwem_pgm", "mst", "one_way"])
def test_mechanisms_stay_within_budget_and_learn(spark, table, name):
    work = workload.k_way(D.attrs, 2)
    run = mechanisms.generator(name)
    options = {"rounds": 6} if name in ("aim", "random_aim", "mwem_pgm") else {}
    made = run(table, D, work, 20.0, 1e-6, seed=1, **options) if name not in ("mst", "one_way") else run(table, D, 20.0, 1e-6, seed=1)
    assert made.ledger.spent <= made.ledger.rho * (1 + 1e-6) and made.ledger.as_frame(spark).count() == len(made.ledger.items)
    rows = made.rows(spark, 6000)
    real, fake = (mechanisms.answers(marginals.dense(x, D, work), D, work) for x in (table, rows))
    error = np.mean([np.abs(real[q] - fake[q]).sum() / 12_000 for q in work])
    assert error < (0.25 if name in ("one_way", "random_aim") else 0.12)


def test_distributed_aim_with_all_clients_equals_the_sum(spark, table):
    work = workload.k_way(D.attrs, 2)
    held = table.withColumn("client", F.pmod(F.xxhash64("a", "b", "c", "d"), F.lit(7)))
    made = mechanisms.distributed_aim(held, "client", D, work, 10.0, 1e-6, q=1.0, seed=1, rounds=4)
    alone = mechanisms.aim(table, D, work, 10.0, 1e-6, seed=1, rounds=4)
    assert made.chosen == alone.chosen
    for q in work:
        assert np.allclose(made.model.project(q).flat(), alone.model.project(q).flat())
    some = mechanisms.distributed_aim(held, "client", D, work, 10.0, 1e-6, q=0.6, seed=1, accumulate=True, rounds=3)
    assert some.ledger.spent <= some.ledger.rho * (1 + 1e-6)


def test_absent_and_unknown_generators():
    with pytest.raises(NotImplementedError):
        mechanisms.generator("ctgan")
    with pytest.raises(ValueError):
        mechanisms.generator("what")


def test_compressed_domain():
    small, maps = mechanisms.compressed_domain(Domain.of({"x": 4, "y": 2}), {"x": np.array([9.0, 1, 8, 2]), "y": np.array([9.0, 9])}, 1.0)
    assert small.config == {"x": 3, "y": 2} and maps["x"].tolist() == [0, 2, 1, 2] and maps["y"].tolist() == [0, 1]


# -- linear plans -------------------------------------------------------------------------------


def test_inference():
    rng = np.random.default_rng(5)
    x = rng.random(8) * 10
    tree = [x + rng.normal(size=8)]
    tree += [x.reshape(-1, 2).sum(1) + rng.normal(size=4), x.reshape(-1, 4).sum(1) + rng.normal(size=2), np.array([x.sum()]) + rng.normal(size=1)]
    a = np.concatenate([np.kron(np.eye(8 >> k), np.ones((1, 1 << k))) for k in range(4)])
    assert np.allclose(inference.tree_least_squares(tree, 2), inference.least_squares([(a, np.concatenate(tree), 1.0)]))
    y = np.array([-1.0, 2, 3])
    assert np.allclose(inference.non_negative([(np.eye(3), y, 1.0)]), [0, 2, 3], atol=1e-6)
    p = linear.prefix_matrix(8)
    assert np.allclose(inference.workload_non_negative(p, [(np.eye(8), x, 1.0)]), x, atol=1e-3)
    mw = inference.multiplicative_weights([(np.eye(8), x)], np.full(8, x.sum() / 8), 400)
    assert np.abs(mw - x).max() < 1
    assert math.isclose(inference.expected_error(np.eye(4), np.eye(4), 1.0), 8.0)
    assert np.allclose(inference.per_query_error(np.eye(4), np.eye(4), 1.0), 2.0) and math.isclose(inference.rmse(np.eye(4), np.eye(4), 1.0), math.sqrt(2))
    assert inference.threshold(np.array([0.5, 100.0]), 1.0, 1.0).tolist() == [0, 100]


@pytest.mark.parametrize("name", sorted(linear.PLANS))
def test_plans_find_the_histogram_without_noise(name):
    x = np.array([5.0, 5, 5, 5, 40, 40, 3, 3, 3, 3, 3, 3, 90, 1, 1, 1])
    found = linear.PLANS[name](x, 1e7, np.random.default_rng(1))
    assert found.shape == x.shape and math.isclose(found.sum(), x.sum(), rel_tol=1e-3)
    if name not in ("uniform", "mwem", "mwem_b", "mwem_c", "mwem_d"):
        assert np.abs(found - x).max() < 1e-2
    elif name != "uniform":
        assert np.abs(np.cumsum(found - x)).max() < 60


@pytest.mark.parametrize("name", sorted(linear.PLANS_2D))
def test_plans_2d(name):
    x = np.random.default_rng(2).integers(0, 50, (8, 8)).astype(float)
    found = linear.PLANS_2D[name](x, 1e7, np.random.default_rng(1))
    assert found.shape == x.shape and np.abs(found - x).max() < 1e-2


def test_haar_and_hierarchy_matrices():
    assert np.linalg.matrix_rank(linear.haar_matrix(8)) == 8
    assert len(linear.hierarchy(8, 2)) == 15 and len(linear.hierarchy(8, 2, root=False)) == 14
    parts = linear.marginals_smart([np.ones(4), np.ones(64)], 1e6, np.random.default_rng(1))
    assert np.allclose(parts[0], 1, atol=1e-3) and np.allclose(parts[1], 1, atol=1e-2)


# -- sweeps --------------------------------------------------------------------------------------


def test_sweep(spark, tmp_path):
    tasks = sweep.grid(spark, {"eps": [1.0, 2.0], "k": [2, 3]})
    assert tasks.count() == 4 and tasks.select("task_id").distinct().count() == 4
    assert sweep.remaining(tasks, tasks.limit(1)).count() == 3
    assert sum(sweep.slice_of(tasks, r, 3).count() for r in range(3)) == 4
    assert sweep.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    tasks.coalesce(1).write.option("header", True).csv(str(tmp_path / "out"))
    assert sweep.merged_results(spark, str(tmp_path / "out")).count() == 4


def test_marginal_gram_algebra():
    shape, rng = (2, 3), np.random.default_rng(3)
    a, b = rng.random(4), rng.random(4)
    product = inference.marginal_gram_product(shape, a**2, b**2)
    assert np.allclose(inference.marginal_gram(shape, a) @ inference.marginal_gram(shape, b), inference.marginal_gram(shape, np.sqrt(product)))
    assert inference.all_norm_k(4, [1, 2]).shape == (10, 4)
