import math

import pytest
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators import encode, evaluate, marginals, matrix, partition, privacy, ranges, shard, updates, workload
from marginalia.streaming import simulate


def test_domain():
    d = Domain.of({"a": 2, "b": 3, "c": 4})
    assert d.size() == 24 and d.size(["a", "c"]) == 8 and d["b"] == 3 and "b" in d and len(d) == 3
    assert d.project(["c", "a"]).attrs == ("c", "a") and d.marginalize(["b"]).attrs == ("a", "c")
    assert d.canonical({"c", "a"}) == ("a", "c") and d.axes(["c", "a"]) == (2, 0)
    assert d.merge(Domain.of({"b": 3, "z": 5})).attrs == ("a", "b", "c", "z")
    assert d.contains(d.project("b")) and not d.project("b").contains(d)
    assert Domain.from_json(d.to_json()) == d and d.sort().attrs == ("a", "b", "c")
    assert d.schema()["b"].metadata == {"size": 3}
    with pytest.raises(ValueError):
        Domain(("a", "a"), (1, 2))


def test_closure_and_target():
    assert workload.closure([("1", "2"), ("2", "3")]) == [("1",), ("2",), ("3",), ("1", "2"), ("2", "3")]
    assert all(q[-1] == "c" and len(q) == 4 for q in workload.k_way_target("abcde", "c", 4))
    assert len(workload.subsample(workload.k_way("abcdef", 2), 5, 0)) == 5
    assert workload.from_bitmask("abc", workload.bitmask("abc", ("a", "c"))) == ("a", "c")
    assert workload.scores([("a", "b"), ("b", "c")])[("b",)] == 2


def test_paths_agree_with_nulls_and_outsiders(spark):
    rows = [(0, 1), (2, 0), (2, 3), (None, 1), (1, 2), (-1, 0), (3, 1), (2, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    d = Domain.of({"a": 2, "b": 3})
    work = workload.some_way(["a", "b"], (1, 2))
    one = {tuple(r) for r in marginals.grouping_sets(df, d, work).select("query_id", "cell", "cnt").collect()}
    assert one == {tuple(r) for r in marginals.dense(df, d, work).select("query_id", "cell", "cnt").collect()}
    assert sum(c for q, _, c in one if q == "a,b") == 5
    full = marginals.zero_filled(marginals.dense(df, d, work), d, work)
    assert full.count() == 2 + 3 + 6
    assert marginals.dense(df.limit(0), d, work).count() == 0


@pytest.mark.parametrize("value, fixed", [(17.42, 1742), (17.4298, 1743), (-2.34, -234), (-2.3456, -235), (-2.3416, -234), (12345.0167, 32767), (-327.69, -32768)])
def test_fixed_point(spark, value, fixed):
    assert spark.range(1).select(updates.to_fixed(F.lit(value), 100.0, 2)).first()[0] == fixed


def test_fixed_to_float(spark):
    row = spark.range(1).select(updates.to_float(F.lit(85), 85.0), updates.to_float(F.lit(157), 85.0)).first()
    assert list(row) == pytest.approx([1.0, 1.847058823529412])


@pytest.mark.parametrize("how, models, want", [("sum", [1, 2], 3), ("average", [1, 2, 3, 4], 2.5), ("weighted_sum", [1, 2, 3, 4, 5, 6], 91)])
def test_reducers(spark, how, models, want):
    frame = spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(models)], "client_id int, idx int, v double")
    w = spark.createDataFrame([(k, float(k + 1)) for k in range(len(models))], "client_id int, weight double")
    assert updates.reduced(frame, w, how).first().v == want
    assert updates.reduced(frame, w.withColumn("weight", F.lit(0.0)), "weighted_average").first().v == 0


def test_event_order(spark):
    rows = [(0, 0, 1.0, 3.0), (1, 1, 3.0, 5.0), (2, 2, 5.0, 1.0), (3, 3, 15.0, 10.0)]
    frame = spark.createDataFrame(rows, "event_id long, client_id long, start_time double, duration double").withColumn("end_time", F.col("start_time") + F.col("duration"))
    order = [(r.kind, r.event_id, r.at) for r in simulate.timeline(frame).orderBy("at", F.desc("kind"), "event_id").collect()]
    assert order[:6] == [("start", 0, 1.0), ("start", 1, 3.0), ("end", 0, 4.0), ("start", 2, 5.0), ("end", 2, 6.0), ("end", 1, 8.0)]


def test_random_starts_and_durations(spark):
    frame = spark.range(4000)
    gaps = simulate.poisson_starts(frame, "id", 2.0, "s")
    assert abs(gaps.agg(F.max("start_time")).first()[0] - 2000) < 150
    for kind, mean in (("gaussian", 5.0), ("uniform", 5.0), ("exponential", 5.0)):
        assert abs(simulate.durations(frame, kind, 5.0, 1.0, "id", "d").agg(F.avg("duration")).first()[0] - mean) < 0.4
    assert simulate.constant_starts(frame, "id", 0.5).agg(F.max("start_time")).first()[0] == 2000


def test_canonical_order(spark):
    frame = spark.createDataFrame(list(enumerate([3, 4, 1, 1, 0, 1])), "cell long, `group` long")
    assert [r.group for r in partition.canonical(frame).orderBy("cell").collect()] == [0, 1, 2, 2, 3, 2]


def test_combined_partition(spark):
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "cell long, `group` long")
    b = spark.createDataFrame([(0, 5), (1, 6), (2, 5), (3, 5)], "cell long, `group` long")
    assert [r.group for r in partition.combined(a, b).orderBy("cell").collect()] == [0, 1, 2, 2]


def test_hilbert_steps_to_neighbours(spark):
    rows = partition.hilbert(spark, 16).orderBy("group").collect()
    assert sorted(r.group for r in rows) == list(range(256))
    at = [divmod(r.cell, 16) for r in rows]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(at, at[1:]))


def test_complement_intervals(spark):
    used = spark.createDataFrame([(0, 2, 1.0), (0, 3, 1.0)], "q long, cell long, val double")
    rows = partition.complement_intervals(used, partition.cells_of(spark, (8,)), 2).orderBy("cell").collect()
    assert [(r.cell, r.group) for r in rows] == [(0, 0), (1, 0), (4, 1), (5, 1), (6, 2), (7, 2)]


def test_matrix_algebra(spark):
    p = matrix.prefix(spark, 3)
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "cell long, x double")
    assert {r.q: r.y for r in matrix.multiply(p, x).collect()} == {0: 1, 1: 3, 2: 7}
    assert {r.q: r.y for r in matrix.multiply(matrix.transpose(p), x).collect()} == {0: 7, 1: 6, 2: 4}
    side = matrix.hstack([(p, 3), (matrix.total(spark, 2), 2)])
    assert side.agg(F.max("cell")).first()[0] == 4
    k = matrix.kronecker(p, matrix.identity(spark, 2), 2, 2)
    y = spark.createDataFrame([(c, float(c)) for c in range(6)], "cell long, x double")
    a = {r.q: r.y for r in matrix.multiply(k, y).collect()}
    assert a == {r.q: r.y for r in matrix.multiply_kronecker(p, matrix.identity(spark, 2), y, 2, 2).collect()}
    assert matrix.trace(matrix.gram(p)).first()[0] == 6
    assert matrix.added(p, matrix.weighted(p, -1.0)).where("val != 0").count() == 0
    m = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "cell long, `group` long")
    both = matrix.matmul(matrix.reduction(m), matrix.expansion(m))
    assert {(r.q, r.cell): r.val for r in both.collect()} == {(0, 0): 1.0, (1, 1): 1.0}


def test_sharders(spark):
    letters = spark.createDataFrame([(chr(97 + k), k) for k in range(26)], "c string, k int")
    assert shard.broadcasted(letters, 10).groupBy("shard").count().where("count = 26").count() == 10
    sizes = [r["count"] for r in shard.iid(letters, "k", 4, 1).groupBy("client_id").count().collect()]
    assert sorted(sizes) == [6, 6, 7, 7]
    assert shard.parse_method("dirch_label_skew_beta=0.5") == ("dirch_label_skew", 0.5)
    with pytest.raises(ValueError):
        shard.parse_method("what")
    parts = shard.vertical(letters, 2, 3)
    assert sorted(c for p in parts for c in p.columns) == ["c", "k"]
    odds = shard.to_probability(spark.createDataFrame([(k, float(k)) for k in range(10)], "client_id int, utility double"), 0.5, 1.0)
    assert abs(odds.agg(F.sum("p")).first()[0] - 1) < 1e-9 and odds.where("p = 0").count() == 5
    assert shard.users_per_round(10, 2.0, [3, 6], 7) == 40


def test_tree_noise_nodes():
    for t in (1, 6, 7, 8):
        nodes = ranges.tree_noise_nodes([t])
        covered = sorted(x for _, level, node in nodes for x in range(node << level, (node + 1) << level))
        assert covered == list(range(t)) and len(nodes) == bin(t).count("1")


def test_best_branching_and_side():
    assert ranges.best_branching(4096) == 16 and ranges.uniform_side(10_000, 0.1, 64) == 7


def test_choice_follows_its_law(spark):
    frame = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "item string, quality double").crossJoin(spark.range(3000).withColumnRenamed("id", "t"))
    picks = privacy.exponential_choice(frame, "item", "quality", 1.0, 1.0, "seed", by=["t"]).groupBy("item").count().collect()
    share = {r.item: r["count"] / 3000 for r in picks}
    assert abs(share["b"] - math.e / (1 + math.e)) < 0.03


def test_statistics_of_nothing(spark):
    assert evaluate.running_statistics(spark.createDataFrame([], "x double"), "x").first().mean == math.inf


def test_row_ids_of_equal_rows(spark):
    frame = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a")], "x int, y string")
    assert [(r.x, r.row_id) for r in encode.row_ids(frame).orderBy("row_id").collect()] == [(1, 1), (1, 2), (2, 3)]


def test_discretise_edges(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (9.0, 5.0)], "x double, y double")
    assert [(r.x, r.y) for r in encode.discretise(frame, {"x": 4, "y": 3}).collect()] == [(0, 0), (0, 0), (None, 0), (3, 0)]


def test_written_tables_can_be_cleaned(spark):
    from marginalia import storage

    frame = storage.written(spark.range(5), "five")
    assert frame.count() == 5 and frame.inputFiles()
    assert storage.clean(spark) >= 1 and storage.clean(spark) == 0


def test_counting_in_parts_of_batches(spark, monkeypatch):
    monkeypatch.setattr(marginals, "ROWS", 3)
    df = spark.range(50).select((F.col("id") % 2).cast("int").alias("a"))
    assert {r.cell: r.cnt for r in marginals.dense(df, Domain.of({"a": 2}), [("a",)]).collect()} == {0: 25, 1: 25}
