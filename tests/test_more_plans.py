import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators import marginals, workload
from marginalia.plans import approximate, federated, mechanisms, pgm, public, structure, trees, utility

D = Domain.of({"a": 2, "b": 3, "c": 2})


@pytest.fixture(scope="module")
def table(spark):
    u = lambda k: F.rand(k)
    base = spark.range(3000).select((u(1) < 0.3).cast("int").alias("a"), u(2).alias("_u"), F.floor(u(3) * 3).cast("int").alias("_b"), (F.col("id") % 5).alias("client"))
    return base.select("a", F.when(F.col("_u") < 0.7, F.col("a")).otherwise(F.col("_b")).alias("b"), "client").withColumn("c", F.when(F.col("b") == 2, 1).otherwise(F.col("a"))).select("a", "b", "c", "client").persist()


@pytest.fixture(scope="module")
def truth(table):
    work = workload.some_way(D.attrs, (1, 2))
    return mechanisms.answers(marginals.dense(table, D, work), D, work)


@pytest.mark.parametrize("steps, times, apart", [(1, 1, 1), (5, 2, 1), (8, 3, 2), (7, 3, 3), (16, 4, 4), (12, 2, 5), (9, 9, 1)])
def test_worst_case_participation(steps, times, apart):
    assert trees.worst_case(steps, times, apart) == trees.brute_force(steps, times, apart)


def test_tree_eps_falls_with_noise():
    assert trees.tree_eps(20.0, 64, 2, 16, 1e-5) < trees.tree_eps(10.0, 64, 2, 16, 1e-5) < trees.tree_eps(10.0, 64, 2, 16, 1e-5, restarts=2)


def test_bayes_network(table):
    network = structure.bayes_network(table, D, 1e6, 2, seed=1)
    assert [len(p) for _, p in network] == [0, 1, 2]
    model, _ = structure.private_bayes(table, D, 1e4, 2, seed=1)
    real = mechanisms.answers(marginals.dense(table, D, [("b", "c")]), D, [("b", "c")])[("b", "c")]
    assert np.abs(model.project(("b", "c")).flat() - real).sum() < 60
    assert structure.mutual_information(np.eye(2)) == pytest.approx(1.0)


def test_loopy_is_exact_on_trees_and_close_on_loops(truth):
    rng = np.random.default_rng(0)
    chain = {q: pgm.Factor(D.project(q), rng.normal(size=D.project(q).shape)) for q in (("a", "b"), ("b", "c"))}
    model = pgm.GraphicalModel(D, list(chain), 10.0)
    model.potentials = {q: chain[q] for q in model.cliques}
    exact = model.belief_propagation(model.potentials)
    found = approximate.loopy(D, chain, 10.0)
    assert all(np.allclose(found[q].values, exact[q].values, atol=1e-6) for q in chain)
    measured = [pgm.Measurement(q, truth[q], 1.0) for q in (("a", "b"), ("b", "c"), ("a", "c"))]
    mu = approximate.local_inference(D, measured)
    assert all(np.abs(mu[m.query].flat() - m.y).sum() < 0.1 * m.y.sum() for m in measured)


def test_mixture(truth):
    measured = [pgm.Measurement(q, truth[q], 10.0) for q in (("a", "b"), ("b", "c"))]
    p, total = approximate.mixture(D, measured)
    for m in measured:
        assert np.abs(approximate.mixture_answers(p, total, m.query) - m.y).sum() < 0.1 * total


def test_dual_query_spends_what_it_may(truth):
    few = approximate.dual_query({("a", "b"): truth["a", "b"]}, D, 0.05, rounds=40)
    many = approximate.dual_query({("a", "b"): truth["a", "b"]}, D, 50.0, rounds=80)
    assert 1 <= len(few) < len(many) == 80
    assert abs((many[:, 0] == 1).mean() - truth["a",][1] / truth["a",].sum()) < 0.2


def test_local_aim_learns_and_keeps_its_budget(spark, table):
    work = workload.k_way(D.attrs, 2)
    made = federated.local_aim(table, "client", D, work, 50.0, 1e-6, 3, 1.0, seed=2)
    assert made.ledger.spent <= made.ledger.rho * (1 + 1e-6)
    assert np.abs(made.model.project(("a",)).flat() / made.model.total - [0.7, 0.3]).max() < 0.05
    start = federated.local_aim_start(table, "client", D, work, 50.0, 1e-6, 1.0)
    assert not start.chosen
    assert federated.local_generators(table, "client", D, 5.0).count() == 3000


def test_public_reweighting(spark, table, truth):
    rows = spark.range(600).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"), (F.col("id") % 2).cast("int").alias("c"))
    made = public.reweighted(rows, D, [pgm.Measurement(("a", "b"), truth["a", "b"], 5.0)], 60)
    got = marginals.datavector(made, D, ("a", "b"), "weight").collect()
    assert sum(r.cnt for r in got) == pytest.approx(3000)
    assert sum(abs(r.cnt - truth["a", "b"][r.cell]) for r in got) < 200


def test_utility(spark, table):
    rows = table.drop("client")
    found = utility.classifier_utility(rows, rows, "c", trees=3)
    assert found["accuracy"] > 0.8 and 0 <= found["f1"] <= 1
    assert utility.classifier_utility(rows.where("c = 1"), rows, "c")["accuracy"] < 1
    assert utility.classifier_utility(rows, rows, "b", trees=3)["accuracy"] > 0.5
    assert utility.regression_utility(rows, rows, "b", trees=3)["r2"] > 0.2


def test_likelihood_prefers_the_fitted_model(spark, table, truth):
    fitted = pgm.estimate(D, [pgm.Measurement(q, truth[q], 1.0) for q in (("a", "b"), ("b", "c"))], iterations=300)
    flat = pgm.GraphicalModel(D, [("a",), ("b",), ("c",)], 3000.0)
    a, b = (utility.negative_log_likelihood(table, m).first().nll for m in (fitted, flat))
    assert a < b == pytest.approx(3000 * np.log(12))


def test_random_shards_keep_repeated_keys_together(spark):
    from marginalia.operators import shard

    frame = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f")], "k long, v string")
    found = shard.random(frame, "k", 2, 5).collect()
    assert sorted(r.v for r in found) == list("abcdef")
    assert len({r.shard for r in found if r.k == 1}) == len({r.shard for r in found if r.k is None}) == 1
    assert {r.shard for r in found} == {0, 1}


def test_rare_values_are_merged_and_drawn_again(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, 6000), np.arange(3, 23)])
    y = np.where(rng.random(len(x)) < 0.9, x % 2, 1 - x % 2)
    frame = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x int, y int")
    found = mechanisms.mst(frame, Domain.of({"x": 23, "y": 2}), 2.0, 1e-6, seed=4, iterations=200)
    assert found.model.domain["x"] == 4 and found.model.domain["y"] == 2
    rows = found.rows(spark, 6020, seed=1).toPandas()
    assert rows.x.between(0, 22).all() and rows.x[rows.x >= 3].nunique() >= 5
    for k in range(3):
        for j in range(2):
            assert abs(((rows.x == k) & (rows.y == j)).sum() - ((x == k) & (y == j)).sum()) < 150


def test_mwem_measures_the_number_of_rows(spark):
    frame = spark.range(5000).selectExpr("CAST(id % 3 AS INT) AS a", "CAST(id % 2 AS INT) AS b")
    found = mechanisms.mwem_pgm(frame, Domain.of({"a": 3, "b": 2}), [("a", "b"), ("a",)], 1.0, 1e-6, rounds=2, iterations=50)
    assert found.model.total != 5000 and abs(found.model.total - 5000) < 100
    assert found.ledger.spent <= found.ledger.rho * (1 + 1e-9)
