"""Noise and private choices as columns over answers.

Noise must go to every cell of the domain (see marginals.zero_filled). The functions take the noise column,
so that tests can replay it and releases can draw it fresh.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_exponential, keyed_gumbel, keyed_laplace, keyed_normal
from marginalia.operators.ordered import numbered, running_max


def gaussian(df: DataFrame, value: str, sigma: float, sensitivity: float, seed, keys: Sequence[str]) -> DataFrame:
    """Adds ``noisy``: the value plus normal noise of deviation sigma * sensitivity."""
    return df.withColumn("noisy", F.col(value) + sigma * sensitivity * keyed_normal(seed, *keys))


def laplace(df: DataFrame, value: str, scale: float, sensitivity: float, seed, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("noisy", F.col(value) + scale * sensitivity * keyed_laplace(seed, *keys))


def exponential_choice(df: DataFrame, item: str, quality: str, epsilon: float, sensitivity: float, seed, base: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group): the exponential mechanism's choice, as the largest of scaled qualities plus
    Gumbel noise, which has the same law. ``base`` is a column of base measures."""
    score = F.col(quality) * (epsilon / (2.0 * sensitivity)) + (F.log(base) if base else F.lit(0.0)) + keyed_gumbel(seed, *by, item)
    return df.groupBy(*by).agg(F.max_by(item, score).alias(item))


def permute_and_flip(df: DataFrame, item: str, quality: str, epsilon: float, sensitivity: float, seed) -> DataFrame:
    """Permute-and-flip, as the largest of scaled qualities plus exponential noise."""
    return df.agg(F.max_by(item, F.col(quality) * (epsilon / (2.0 * sensitivity)) + keyed_exponential(seed, item)).alias(item))


def noisy_max(df: DataFrame, item: str, score: str, epsilon: float, sensitivity: float, seed, measured: Sequence[str] = ()) -> DataFrame:
    """The largest score plus Laplace noise; what is measured already scores 0."""
    own = F.when(F.col(item).isin(list(measured)), 0.0).otherwise(F.col(score)) if measured else F.col(score)
    return df.agg(F.max_by(item, own + (2.0 * sensitivity / epsilon) * keyed_laplace(seed, item)).alias(item))


def exponential_probabilities(df: DataFrame, quality: str, epsilon: float, sensitivity: float) -> DataFrame:
    """Adds ``p``, the exponential mechanism's probability of each row."""
    scaled = df.withColumn("_q", F.col(quality) * (epsilon / (2.0 * sensitivity)))
    top = F.broadcast(scaled.agg(F.max("_q").alias("_m")))  # one row
    weights = scaled.crossJoin(top).withColumn("_e", F.exp(F.col("_q") - F.col("_m")))
    return weights.crossJoin(F.broadcast(weights.agg(F.sum("_e").alias("_s")))).withColumn("p", F.col("_e") / F.col("_s")).drop("_q", "_m", "_e", "_s")


def generalised_scores(df: DataFrame, item: str, quality: str, sensitivity: str, t: float) -> DataFrame:
    """(item, score): the least margin, scaled by both sensitivities, over all candidates. Only
    candidates that no other beats in both quality and sensitivity can be the least, and they are few."""
    front = F.broadcast(pareto(df, quality, sensitivity).select(F.col(quality).alias("_q"), F.col(sensitivity).alias("_s")).distinct())
    margin = ((F.col(quality) - t * F.col(sensitivity)) - (F.col("_q") - t * F.col("_s"))) / (F.col(sensitivity) + F.col("_s"))
    return df.crossJoin(front).groupBy(item).agg(F.min(margin).alias("score"))


def pareto(df: DataFrame, quality: str, sensitivity: str) -> DataFrame:
    """Rows that no other row beats: higher quality at no more sensitivity, or less at no lower quality.
    One sorted pass per distinct sensitivity instead of comparing all pairs."""
    best = df.groupBy(sensitivity).agg(F.max(quality).alias("_best"))
    front = running_max(best, [sensitivity], "_best", "_most").where("_best = _most").groupBy("_best").agg(F.min(sensitivity).alias("_least"))
    return df.join(front, (F.col(sensitivity) == F.col("_least")) & (F.col(quality) == F.col("_best"))).select(df.columns)


def clipped(df: DataFrame, client: str, value: str, most: float) -> DataFrame:
    """Scales each client's vector to a Euclidean norm of at most ``most``."""
    norms = df.groupBy(client).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    return df.join(norms, client).withColumn(value, F.col(value) * F.least(F.lit(1.0), most / (F.col("_norm") + 1e-10))).drop("_norm")


def rare_cells_merged(counts: DataFrame, attr: str, noisy: str, threshold: float) -> DataFrame:
    """(attr, code): values with a noisy count of ``threshold`` or more keep codes of their own, in
    order; all others share the next code."""
    kept = counts.where(F.col(noisy) >= threshold)
    ranked = numbered(kept.select(attr), [attr], "code").withColumn("code", F.col("code").cast("int"))
    rest = F.broadcast(kept.agg(F.count("*").cast("int").alias("_n")))
    return counts.join(ranked, attr, "left").crossJoin(rest).select(attr, F.coalesce("code", "_n").alias("code"))


def sign_of(c: Column) -> Column:
    return F.signum(c)
