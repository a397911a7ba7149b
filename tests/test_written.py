import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import queries
from marginalia.domain import Domain
from marginalia.functions.rng import keyed_normal
from marginalia.operators import evaluate, rounds, shard
from marginalia.plans import accounting, pgm
from marginalia.sources import sinks
from tests.conftest import SF


@pytest.mark.parametrize("total, shares", [(100, [0.5, 0.3, 0.2]), (10, [0.98, 0.01, 0.01]), (4, [0.4, 0.35, 0.25]), (2, [0.1, 0.1, 0.8]), (0, [0.5, 0.5]), (5, [0.0, 0.0, 1.0, 0.0])])
def test_dirichlet_sizes(total, shares):
    sizes = shard.dirichlet_sizes(total, shares)
    assert sizes.sum() == total and sizes.min() >= (1 if total >= len(shares) else 0)


def test_capped_split_follows_its_sizes(spark):
    found = queries.label_skew_capped(spark, SF).collect()
    labels = sorted({r.o_orderpriority for r in found})
    counts = [sum(r.o_orderpriority == y for r in found) for y in labels]
    sizes = shard.capped_sizes(counts, 6, 0.5, 3)
    rows = {(r.o_orderkey, r.o_orderpriority): r.client_id for r in found}
    drawn = spark.createDataFrame(list(rows), "o_orderkey bigint, y string").withColumn("u", queries.shard.keyed_uniform(3, "o_orderkey")).collect()
    for y, own in zip(labels, sizes):
        order = sorted((r.u, r.o_orderkey) for r in drawn if r.y == y)
        wanted = [k for k, n in enumerate(own) for _ in range(n)]
        assert [rows[key, y] for _, key in order] == wanted
    held = np.zeros(6)
    for own in sizes:  # who is full takes none
        assert not own[held >= sum(counts) / 6].any()
        held += own
    assert held.min() >= 2 and held.sum() == len(found)


def test_capped_split_needs_rows():
    with pytest.raises(ValueError):
        shard.capped_sizes([3, 4], 4, 1.0, 0)


def test_splits_keep_repeated_rows_and_null_labels(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id bigint, y string")
    found = shard.label_skew(df, "id", "y", 2, 1.0, 0)
    assert sorted((r.id, str(r.y)) for r in found.collect()) == sorted((r.id, str(r.y)) for r in df.collect())
    assert shard.sample_skew_dirichlet(df, "id", 3, 1.0, 0).count() == 6
    assert shard.label_skew(df.limit(0), "id", "y", 2, 1.0, 0).count() == 0


def test_efficient_noise_by_a_stack(spark):
    z = {(r.l, r.id): r.z for r in spark.range(64).select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("l")).withColumn("z", 3.0 * keyed_normal("s", "l", "id")).collect()}
    stack, wanted = [], []
    for step in range(1, 24):
        stack.append((0, step - 1, z[0, step - 1]))
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (h, at, left), (_, _, right) = stack[-2:]
            stack[-2:] = [(h + 1, at // 2, z[h + 1, at // 2] + (left + right) / 2)]
        wanted.append(sum(v / (2 - 0.5**h) for h, _, v in stack))
    found = rounds.efficient_prefix_noise(spark.range(1, 24).withColumnRenamed("id", "step"), 3.0, "s").orderBy("step").collect()
    assert [r.noise for r in found] == pytest.approx(wanted)


def test_best_noise():
    assert accounting.best_noise(1.0, 1.0, 1.0, 1e-9)[0] == "laplace"
    kind, sigma = accounting.best_noise(100.0, 1.0, 1.0, 1e-6)
    assert kind == "gaussian" and sigma < math.sqrt(2) * 100
    assert accounting.best_noise(2.0, 1.0, 0.5, 0.0) == ("laplace", 4.0)


def test_model_round_trip(spark, tmp_path):
    domain = Domain.of({"a": 2, "b": 3, "c": 4})
    model = pgm.GraphicalModel(domain, [("a", "b"), ("b", "c")], 50.0)
    rng = np.random.default_rng(0)
    for q in model.cliques:
        model.potentials[q] = pgm.Factor(domain.project(q), rng.normal(size=domain.project(q).shape))
    model.marginals = model.belief_propagation(model.potentials)
    sinks.save_model(spark, model, str(tmp_path / "m"))
    found = sinks.load_model(spark, str(tmp_path / "m"))
    for q in (("a",), ("a", "c"), ("c", "b")):
        assert found.project(q).values == pytest.approx(model.project(q).values)


def test_cache_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for seed in (1, 1, 2):
        assert sinks.cached(spark, str(tmp_path), {"seed": seed}, make).count() == 5
    assert len(made) == 2


def test_no_jobs_pend_for_ever(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert evaluate.pending_jobs(none, "a", "b").first().pending == math.inf
    jobs = spark.createDataFrame([(0.0, 3.0), (1.0, 2.0), (2.0, 5.0)], "a double, b double")
    assert evaluate.pending_jobs(jobs, "a", "b").first().pending == pytest.approx((3 + 2 + 1) / 3)


def test_best_metric_ties_and_nulls(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 2.0), ("x", 3, None), ("y", 4, None)], "g string, t int, m double")
    assert [tuple(r) for r in evaluate.best_metric(df, "g", "m", "t").collect()] == [("x", 1, 2.0)]


def test_half_a_cache_is_not_read(spark, tmp_path):
    """What a lost job left does not count, nor does a second writer's table replace the first."""
    from marginalia.sources import sinks

    settings, calls = {"seed": 1}, []

    def make():
        calls.append(1)
        return spark.range(5)

    assert sinks.cached(spark, str(tmp_path), settings, make).count() == 5
    marker = next(p for p in tmp_path.iterdir() if p.name.startswith("_made-"))
    (tmp_path / marker.name.replace("_made-", "").replace("@", "-")).rename(tmp_path / "elsewhere")
    marker.unlink()  # as if the job had been lost before it was done
    assert sinks.cached(spark, str(tmp_path), settings, make).count() == 5 and len(calls) == 2
    assert sinks.cached(spark, str(tmp_path), settings, make).count() == 5 and len(calls) == 2


def test_splits_of_many_classes(spark):
    from marginalia.operators import shard

    frame = spark.range(400_000).selectExpr("id", "CAST(id % 200000 AS STRING) AS label")
    found = shard.label_skew(frame, "id", "label", 3, 0.5, 1).groupBy("client_id").count().collect()
    assert sum(r["count"] for r in found) == 400_000 and {r.client_id for r in found} == {0, 1}  # two rows a class
