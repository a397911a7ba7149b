"""Asynchronous training as event tables: trainings (event_id, client_id, start_time, duration, end_time).

A global order over all events is inherent to a buffer that counts arrivals; it is taken in ranges of
time, so that only a count per range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_exponential, keyed_normal, keyed_uniform
from marginalia.operators.ordered import numbered, running_max, running_sum


def poisson_starts(df: DataFrame, order: str, rate: float, seed) -> DataFrame:
    """Adds start_time: running sums of exponential gaps."""
    gaps = df.withColumn("_gap", keyed_exponential(seed, order) / rate)
    return running_sum(gaps, [order], "_gap", "start_time").drop("_gap")


def constant_starts(df: DataFrame, order: str, gap: float) -> DataFrame:
    return numbered(df, [order], "_place").withColumn("start_time", (F.col("_place") + 1) * gap).drop("_place")


def durations(df: DataFrame, kind: str, mean: float, sd: float, key: str, seed, least: float = 0.0, examples: str | None = None) -> DataFrame:
    """Adds duration: gaussian, half_normal, uniform or exponential by key, times examples if given."""
    value = {
        "gaussian": mean + sd * keyed_normal(seed, key),
        "half_normal": mean + sd * F.abs(keyed_normal(seed, key)),
        "uniform": mean * 2 * keyed_uniform(seed, key),
        "exponential": mean * keyed_exponential(seed, key),
    }[kind]
    return df.withColumn("duration", F.greatest(F.lit(least), value) * (F.col(examples) if examples else 1.0))


def timeline(trainings: DataFrame) -> DataFrame:
    """(event_id, client_id, kind, at, running): starts and ends in order (a start before an end at the
    same time), and how many trainings run after each."""
    start = trainings.select("event_id", "client_id", F.lit("start").alias("kind"), F.col("start_time").alias("at"), F.lit(1).alias("step"))
    end = trainings.select("event_id", "client_id", F.lit("end").alias("kind"), F.col("end_time").alias("at"), F.lit(-1).alias("step"))
    return running_sum(start.union(end), ["at", F.desc("kind"), "event_id"], "step", "running").drop("step")


def buffered(trainings: DataFrame, size: int) -> DataFrame:
    """Adds version: how many buffers of ``size`` ended trainings came before this one's."""
    return numbered(trainings, ["end_time", "event_id"], "_place").withColumn("version", F.expr(f"_place div {size}")).drop("_place")


def staleness(trainings: DataFrame, size: int) -> DataFrame:
    """Adds staleness: the version to which a training adds, less the one current when it began. The
    as-of lookup is a running maximum over versions and starts merged by time."""
    own = buffered(trainings, size)
    made = own.groupBy("version").agg(F.max("end_time").alias("at"), F.count("*").alias("n")).where(F.col("n") == size).select("at", (F.col("version") + 1).alias("made"), F.lit(None).cast("bigint").alias("event_id"))
    asked = own.select(F.col("start_time").alias("at"), F.lit(None).cast("bigint").alias("made"), "event_id")
    both = made.unionByName(asked).withColumn("_asks", F.col("event_id").isNotNull())
    seen = running_max(both, ["at", "_asks", "event_id"], "made", "began").where("_asks").select("event_id", F.coalesce("began", F.lit(0)).alias("began"))
    return own.join(seen, "event_id").withColumn("staleness", F.col("version") - F.col("began")).drop("began")


def kept(trainings: DataFrame, most: int) -> DataFrame:
    """Updates that are at most so stale."""
    return trainings.where(F.col("staleness") <= most)


def timed_out(trainings: DataFrame, wall: float) -> DataFrame:
    """Durations cut at the wall, with whether the training ran into it."""
    return trainings.withColumns({"timed_out": F.col("duration") >= wall, "duration": F.least(F.col("duration"), F.lit(wall))})


def time_estimates(trainings: DataFrame, per_round: int, wall: float) -> DataFrame:
    """One row: seconds of synchronous rounds (each as long as its slowest) and of one asynchronous run."""
    rounds = numbered(timed_out(trainings, wall).select("event_id", "duration"), ["event_id"], "_place").groupBy(F.expr(f"_place div {per_round}").alias("round")).agg(F.max("duration").alias("m"))
    sync = rounds.agg(F.round(F.sum("m"), 6).alias("sync_seconds"))
    return sync.crossJoin(trainings.agg(F.round(F.max("end_time") - F.min("start_time"), 6).alias("async_seconds")))  # two rows
