"""What synthetic rows are worth: models trained on them and tested on real rows; likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.cells import cell
from marginalia.plans.pgm import GraphicalModel


def classifier_utility(train: DataFrame, test: DataFrame, label: str, trees: int = 100, depth: int = 4, seed: int = 0) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1 on ``test`` of gradient-boosted trees (two labels) or
    a forest (more) trained on ``train``; one label only predicts itself."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    features = [c for c in train.columns if c != label]
    labels = [r[0] for r in train.select(label).distinct().collect()]
    if len(labels) < 2:
        predicted = test.withColumn("prediction", F.lit(float(labels[0]) if labels else -1.0))
    else:
        gather = VectorAssembler(inputCols=features, outputCol="_x")
        kind = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed) if max(labels) <= 1 else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
        model = kind.setFeaturesCol("_x").setLabelCol("_y").fit(gather.transform(train.withColumn("_y", F.col(label).cast("double"))))
        predicted = model.transform(gather.transform(test)).select(label, "prediction")
    return scores(predicted.select(F.col(label).cast("double").alias("y"), "prediction"))


def scores(predicted: DataFrame) -> dict[str, float]:
    """From (y, prediction): the confusion table is as small as the labels."""
    table = {(r.y, r.prediction): r["count"] for r in predicted.groupBy("y", "prediction").count().collect()}
    labels = sorted({k for pair in table for k in pair})
    n = sum(table.values())
    hit = lambda c: table.get((c, c), 0)
    precision = [hit(c) / max(1, sum(v for (_, p), v in table.items() if p == c)) for c in labels]
    recall = [hit(c) / max(1, sum(v for (y, _), v in table.items() if y == c)) for c in labels]
    f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(precision, recall)]
    return {"accuracy": sum(map(hit, labels)) / max(1, n), "precision": sum(precision) / len(labels), "recall": sum(recall) / len(labels), "f1": sum(f1) / len(labels)}


def regression_utility(train: DataFrame, test: DataFrame, label: str, trees: int = 100, depth: int = 4, seed: int = 0) -> dict[str, float]:
    """r2, mse, mae and the largest error of gradient-boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gather = VectorAssembler(inputCols=[c for c in train.columns if c != label], outputCol="_x")
    model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="_x", labelCol="_y").fit(gather.transform(train.withColumn("_y", F.col(label).cast("double"))))
    d = F.col("prediction") - F.col(label)
    r = model.transform(gather.transform(test)).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("largest"), F.var_pop(label).alias("v")).first()
    return {"r2": 1 - r.mse / r.v if r.v else 0.0, "mse": r.mse, "mae": r.mae, "largest": r.largest}


def negative_log_likelihood(rows: DataFrame, model: GraphicalModel) -> DataFrame:
    """One row, ``nll``: of rows under the model, a lookup of each clique's potential."""
    total = F.lit(0.0)
    for q, f in model.potentials.items():
        listed = F.array(*(F.lit(float(v)) for v in f.flat()))
        total = total + F.element_at(listed, (cell(q, model.domain.project(q).shape) + 1).cast("int"))
    return rows.agg((F.count("*") * model.log_z - F.sum(total)).alias("nll"))
