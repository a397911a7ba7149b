"""Local training of clients, channels that need numpy, and server steps."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def local_logistic(rows: DataFrame, weights: np.ndarray, rate: float, epochs: int = 1, batch: int = 32, proximal: float = 0.0, clip: float | None = None, noise: float = 0.0, shuffle_scale: bool = False, seed: int = 0) -> DataFrame:
    """(client_id, n, delta array): what each client's rows (client_id, x array, y) change in a logistic
    model by mini-batch SGD. ``proximal`` pulls towards the start, ``clip`` and ``noise`` make the steps
    private per example, ``shuffle_scale`` divides the change by the client's number of steps. A client's
    rows are one group: clients are devices, and their data is small by nature."""
    start = np.asarray(weights, dtype=float)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(part["x"]), part["y"].to_numpy(float)
        rng = np.random.default_rng([seed, int(part["client_id"].iloc[0]) & 0x7FFFFFFF])
        w, steps = start.copy(), 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                gap = 1 / (1 + np.exp(-np.clip(x[own] @ w, -30, 30))) - y[own]
                each = gap[:, None] * x[own]
                if clip is not None:
                    each *= np.minimum(1.0, clip / (np.linalg.norm(each, axis=1, keepdims=True) + 1e-10))
                g = each.mean(axis=0)
                if noise:
                    g = g + rng.normal(0, noise * (clip or 1.0) / len(own), g.size)
                w = w - rate * (g + proximal * (w - start))
                steps += 1
        delta = (start - w) / (steps if shuffle_scale and steps else 1)
        return pd.DataFrame({"client_id": part["client_id"].iloc[:1], "n": [len(y)], "delta": [delta.tolist()]})

    return rows.groupBy("client_id").applyInPandas(fit, "client_id bigint, n bigint, delta array<double>")


def evaluate_logistic(rows: DataFrame, weights: np.ndarray, by: str | None = None) -> DataFrame:
    """Accuracy and log loss over rows (x, y), of each value of ``by`` if given; no Python per row."""
    score = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    margin = F.when(F.col("y") > 0.5, F.col("_s")).otherwise(-F.col("_s"))
    loss = F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))
    return rows.withColumn("_s", score).groupBy(*([by] if by else [])).agg(F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(loss).alias("loss"), F.count("*").alias("n"))


@pandas_udf(T.ArrayType(T.DoubleType()))
def half_precision(v: pd.Series) -> pd.Series:
    """Vectors as they come out of a channel of 16-bit floats."""
    return v.map(lambda x: np.asarray(x, dtype=np.float16).astype(np.float64).tolist())


def product_quantised(vectors: DataFrame, block: int, codes: int, seed: int = 7) -> DataFrame:
    """(client_id, block, code, values): sub-vectors of ``block`` components replaced by the nearest of
    ``codes`` centres, learned by k-means over all of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    parts = vectors.select("client_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("CAST(size(v) AS INT) - 1"), F.lit(block)), lambda k: F.slice("v", k + 1, block))).alias("block", "part"))
    parts = parts.withColumn("features", array_to_vector("part"))
    model = KMeans(k=codes, seed=seed, maxIter=10).fit(parts)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    return model.transform(parts).select("client_id", "block", F.col("prediction").alias("code"), F.element_at(centres, F.col("prediction") + 1).alias("values"))


# -- server --------------------------------------------------------------------------------------


@dataclass
class ServerOptimizer:
    """Applies an aggregated change to the model: ``sgd`` with momentum, ``fedavg``, ``adam``, ``lars``
    or ``lamb`` (whose steps are scaled by norms)."""

    kind: str = "fedavg"
    rate: float = 1.0
    momentum: float = 0.0
    beta2: float = 0.99
    epsilon: float = 1e-8
    decay: float = 0.0
    _m: np.ndarray | None = field(default=None, repr=False)
    _v: np.ndarray | None = field(default=None, repr=False)
    _t: int = 0

    def step(self, w: np.ndarray, delta: np.ndarray) -> np.ndarray:
        self._t += 1
        g = delta + self.decay * w
        if self.kind == "fedavg":
            return w - self.rate * delta
        if self._m is None:
            self._m, self._v = np.zeros_like(w), np.zeros_like(w)
        if self.kind == "sgd":
            self._m = self.momentum * self._m + g
            return w - self.rate * self._m
        if self.kind == "lars":
            self._m = self.momentum * self._m + g * _trust(w, g)
            return w - self.rate * self._m
        self._m = self.momentum * self._m + (1 - self.momentum) * g
        self._v = self.beta2 * self._v + (1 - self.beta2) * g * g
        step = (self._m / (1 - self.momentum**self._t)) / (np.sqrt(self._v / (1 - self.beta2**self._t)) + self.epsilon)
        if self.kind == "adam":
            return w - self.rate * step
        if self.kind == "lamb":
            return w - self.rate * _trust(w, step) * step
        raise ValueError(f"unknown optimizer: {self.kind}")


def _trust(w: np.ndarray, g: np.ndarray) -> float:
    a, b = float(np.linalg.norm(w)), float(np.linalg.norm(g))
    return a / b if a > 0 and b > 0 else 1.0


def constant_rate(rate: float) -> Callable[[int], float]:
    return lambda t: rate


def step_rate(rate: float, every: int, gamma: float) -> Callable[[int], float]:
    return lambda t: rate * gamma ** (t // every)


def multi_step_rate(rate: float, milestones: list[int], gamma: float) -> Callable[[int], float]:
    return lambda t: rate * gamma ** sum(t >= m for m in milestones)


def armijo_rate(loss: Callable[[np.ndarray], float], w: np.ndarray, g: np.ndarray, rate: float = 1.0, shrink: float = 0.5, c: float = 0.5, least: float = 1e-6) -> float:
    """The largest tried rate whose step lowers the loss enough."""
    now, slope = loss(w), float(g @ g)
    while rate > least and loss(w - rate * g) > now - c * rate * slope:
        rate *= shrink
    return rate


def train(rows: DataFrame, cohorts: Callable[[int], DataFrame], size: int, rounds: int, rate: float, optimizer: ServerOptimizer, **local) -> tuple[np.ndarray, list[float]]:
    """Synchronous rounds: the cohort (client_id) trains, changes are averaged by examples, the server
    steps. Only the sum of changes comes to the driver, as long as the model."""
    w, losses = np.zeros(size), []
    for t in range(rounds):
        deltas = local_logistic(rows.join(cohorts(t), "client_id", "left_semi"), w, rate, **local)
        sums = deltas.select("n", F.posexplode("delta").alias("idx", "v")).groupBy("idx").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).collect()
        mean = np.zeros(size)
        for r in sums:
            mean[r.idx] = r.v
        w = optimizer.step(w, mean)
        losses.append(evaluate_logistic(rows, w).first().loss)
    return w, losses


def diverged(losses: list[float]) -> bool:
    return any(not math.isfinite(x) for x in losses)
