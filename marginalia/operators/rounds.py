"""Figures over rounds: ranks, votes, moving statistics, targets, prefix noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_normal


def rank_error(scores: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """(group, error): mean distance between an item's ranks by two scores; ties by item."""
    rank = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), item))
    return scores.withColumns({"_a": rank(a), "_b": rank(b)}).groupBy(group).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("error"))


def majority(votes: DataFrame, item: str, most: int, first: str) -> DataFrame:
    """(item, votes) of the ``most`` items with the most votes; ties go to whom ``first`` saw first."""
    return votes.groupBy(item).agg(F.count("*").alias("votes"), F.min(first).alias("_f")).orderBy(F.desc("votes"), "_f").limit(most).select(item, "votes")


def moving(df: DataFrame, group: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """Adds ``mean`` and ``deviation`` of the last ``width`` values of each group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(width - 1), 0)
    return df.withColumns({"mean": F.avg(value).over(w), "deviation": F.stddev_pop(value).over(w)})


def exponential_moving(df: DataFrame, group: str, order: Sequence[str], value: str, width: int, alpha: float) -> DataFrame:
    """Adds ``mean``: the exponentially weighted mean of the last ``width`` values, newest first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(width - 1), 0)
    weighted = F.transform(F.reverse(F.col("_seen")), lambda x, i: F.struct((x * F.pow(F.lit(1.0 - alpha), i)).alias("x"), F.pow(F.lit(1.0 - alpha), i).alias("w")))
    total = lambda name: F.aggregate(F.transform("_w", lambda s: s[name]), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("_seen", F.collect_list(F.col(value).cast("double")).over(w)).withColumn("_w", weighted).withColumn("mean", total("x") / total("w")).drop("_seen", "_w")


def target_reached(df: DataFrame, group: str, order: str, value: str, width: int, target: float, rising: bool = True) -> DataFrame:
    """(group, reached): the first place at which the mean of the last ``width`` values, all there,
    crosses the target; null if none does."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-(width - 1), 0)
    seen = df.withColumns({"_m": F.avg(value).over(w), "_n": F.count(value).over(w)})
    hit = (F.col("_n") >= width) & ((F.col("_m") > target) if rising else (F.col("_m") < target))
    return seen.groupBy(group).agg(F.min(F.when(hit, F.col(order))).alias("reached"))


def timeline(epoch: Column, round_: Column, rounds_per_epoch: int) -> tuple[Column, Column]:
    """The global round, from 1, and the number of epochs that are over, of a round of an epoch, both from 1."""
    at = (epoch - 1) * rounds_per_epoch + round_
    return at, at / rounds_per_epoch


def prefix_noise(steps: DataFrame, deviation: float, seed) -> DataFrame:
    """Adds ``noise`` to each whole ``step``: the sum of the noises of the tree nodes that make up the
    first ``step`` values, one per set bit, each drawn once for its node."""
    bits = F.expr("filter(sequence(0, 62), k -> (shiftright(step, k) & 1L) = 1L)")
    # the node of bit k covers the 2^k values that end where the step's higher and own bits end
    nodes = steps.select(*steps.columns, F.explode(bits).alias("_level")).withColumn("_node", F.expr("shiftright(step, _level) - 1"))
    noisy = nodes.withColumn("_z", deviation * keyed_normal(seed, "_level", "_node"))
    return noisy.groupBy(*steps.columns).agg(F.sum("_z").alias("noise"))


def efficient_prefix_noise(steps: DataFrame, deviation: float, seed) -> DataFrame:
    """As prefix_noise, with every node estimated from all draws below it as well: a node's value is its own
    draw and half the sum of its halves' values, and one of level h counts 1 / (2 - 2^-h). Each node's draw
    is sent to its ancestors with its weight, so there is one sum by node and one by step."""
    last = steps.agg(F.max("step")).first()[0] or 0
    top = max(int(last).bit_length() - 1, 0)
    spark = steps.sparkSession
    levels = spark.range(top + 1).select(F.explode(F.sequence("id", F.lit(top).cast("long"))).alias("_level"), F.col("id").alias("_below"))
    draws = spark.range(last).select("id", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_below")).where(F.expr(f"shiftleft(id + 1, _below) <= {last}"))
    draws = draws.withColumn("_z", deviation * keyed_normal(seed, "_below", "id"))
    sent = draws.join(F.broadcast(levels), "_below")  # at most 63 * 64 / 2 rows
    up = F.expr("shiftright(id, CAST(_level - _below AS INT))")
    nodes = sent.groupBy("_level", up.alias("_node")).agg(F.sum(F.col("_z") / F.pow(F.lit(2.0), F.col("_level") - F.col("_below"))).alias("_v"))
    bits = steps.select(*steps.columns, F.explode(F.expr("filter(sequence(0L, 62L), k -> (shiftright(step, CAST(k AS INT)) & 1L) = 1L)")).alias("_level"))
    bits = bits.withColumn("_node", F.expr("shiftright(step, CAST(_level AS INT)) - 1"))
    weighted = bits.join(nodes, ["_level", "_node"]).withColumn("_w", F.col("_v") / (2.0 - F.pow(F.lit(2.0), -F.col("_level"))))
    return weighted.groupBy(*steps.columns).agg(F.sum("_w").alias("noise"))


def worst(scores: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """(group, item, place) of each group's ``k`` largest scores."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(group, item, "place")


def covering(queries: DataFrame, cliques: DataFrame) -> DataFrame:
    """(query_id, clique_id): the smallest clique (clique_id, attrs, size) that has all of a query's
    attributes; both tables are as small as a model."""
    c = F.broadcast(cliques.select("clique_id", F.col("attrs").alias("_c"), "size"))
    met = queries.join(c, F.size(F.array_except("attrs", "_c")) == 0)
    return met.groupBy("query_id").agg(F.min_by("clique_id", F.struct("size", "clique_id")).alias("clique_id"))


def weighted_total(measured: DataFrame) -> DataFrame:
    """One row: the total that measurements (query_id, y array, sigma) of all cells agree on best, each
    weighted by the variance of its sum; 1 at least."""
    sums = measured.select(F.aggregate("y", F.lit(0.0), lambda s, v: s + v).alias("s"), (F.col("sigma") * F.col("sigma") * F.size("y")).alias("var"))
    return sums.agg(F.greatest(F.lit(1.0), F.sum(F.col("s") / F.col("var")) / F.sum(1 / F.col("var"))).alias("total"))
