"""What is written to be read again: models, rows, results of sweeps, and caches by settings."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from marginalia.domain import Domain
from marginalia.plans.pgm import Factor, GraphicalModel
from marginalia.sources.tabular import read_text


def cached(spark: SparkSession, folder: str, settings: dict, make: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The table that ``make`` gives, written once for each ``settings`` and read from then on. It is written to a
    folder of its own, and counts from when an empty file names that folder, so half a table is never read, and
    no store has to rename anything. Of jobs that write at once all are whole, and all read the one whose name comes first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    name = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    root = folder.rstrip("/")
    store = of(root).getFileSystem(conf)

    def made() -> list[str]:
        return sorted(s.getPath().getName().split("@")[1] for s in store.globStatus(of(f"{root}/_made-{name}@*")) or ())

    if not made():
        own = uuid.uuid4().hex
        make().write.partitionBy(*by).parquet(f"{root}/{name}-{own}")
        store.create(of(f"{root}/_made-{name}@{own}"), False).close()
    return spark.read.parquet(f"{root}/{name}-{made()[0]}")


def save_model(spark: SparkSession, model: GraphicalModel, path: str) -> None:
    """A model as rows (clique, cell, potential) and a line of JSON with its domain, total and order."""
    cliques = model.cliques
    rows = pd.concat([pd.DataFrame({"clique": k, "cell": np.arange(f.values.size), "potential": f.values.ravel()}) for k, f in ((k, model.potentials[q]) for k, q in enumerate(cliques))])
    spark.createDataFrame(rows, "clique int, cell bigint, potential double").write.mode("overwrite").parquet(f"{path}/potentials")
    about = {"domain": model.domain.config, "cliques": [list(q) for q in cliques], "axes": [list(model.potentials[q].domain.attrs) for q in cliques], "total": float(model.total), "order": list(model.tree.order)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> GraphicalModel:
    """A saved model, with its marginals. It is as large as it was when saved, some tens of MB by the limit of
    those that choose cliques."""
    about = json.loads(read_text(spark, f"{path}/about"))
    model = GraphicalModel(Domain.of(about["domain"]), [tuple(q) for q in about["cliques"]], about["total"], about["order"])
    rows = spark.read.parquet(f"{path}/potentials").toPandas().sort_values(["clique", "cell"])
    names = {frozenset(q): q for q in model.cliques}
    for k, own in rows.groupby("clique"):
        domain = model.domain.project(about["axes"][k])
        model.potentials[names[frozenset(about["cliques"][k])]] = Factor(domain, own["potential"].to_numpy().reshape(domain.shape))
    model.marginals = model.belief_propagation(model.potentials)
    return model


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_result(spark: SparkSession, folder: str, task_id: str, result: dict) -> None:
    """One row of a sweep's results; a task that runs again replaces its own. sweep.merged_results reads all."""
    row = {"task_id": task_id, **result}
    write_csv(spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1), f"{folder.rstrip('/')}/task-{task_id}")
