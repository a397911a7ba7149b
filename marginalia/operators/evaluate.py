"""How far two tables are apart on a workload, and other figures of merit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.operators.marginals import marginals, normalised
from marginalia.operators.ordered import running_sum
from marginalia.operators.workload import Query


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, cell, x, y): counts of both tables, 0 where one has none."""
    return a.select("query_id", "cell", F.col("cnt").alias("_x")).join(b.select("query_id", "cell", F.col("cnt").alias("_y")), ["query_id", "cell"], "full").select("query_id", "cell", F.coalesce("_x", F.lit(0)).alias("x"), F.coalesce("_y", F.lit(0)).alias("y"))


def query_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, l1, l2, tv, largest) of two answers; all but ``largest``, which is in rows, are of
    answers that sum to 1."""
    raw = aligned(a, b).groupBy("query_id").agg(F.max(F.abs(F.col("x") - F.col("y"))).cast("double").alias("largest"))
    d = F.col("x") - F.col("y")
    shares = aligned(normalised(a), normalised(b)).groupBy("query_id").agg(F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"))
    return shares.join(raw, "query_id").select("query_id", "l1", "l2", (F.col("l1") / 2).alias("tv"), "largest")


def workload_errors(real: DataFrame, synthetic: DataFrame, domain: Domain, workload: Sequence[Query]) -> DataFrame:
    """One row per size of query and one for all (k is null): average and summed errors."""
    each = query_errors(marginals(real, domain, workload), marginals(synthetic, domain, workload)).withColumn("k", F.size(F.split("query_id", ",")))
    return each.rollup("k").agg(F.count("*").alias("queries"), *(F.avg(c).alias(f"avg_{c}") for c in ("l1", "l2", "tv")), F.sum("l1").alias("sum_l1"), F.max("largest").alias("largest"))


def relative_l1(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: summed distance over the summed answers of ``a``."""
    return aligned(a, b).agg((F.sum(F.abs(F.col("x") - F.col("y"))) / F.sum(F.abs("x"))).alias("error"))


def heterogeneity(by_client: DataFrame, client: str) -> DataFrame:
    """One row: mean, deviation, least and largest over clients of the mean TV distance of a client's
    answers (client, query_id, cell, cnt) to those of all."""
    whole = by_client.groupBy("query_id", "cell").agg(F.sum("cnt").alias("g"))
    totals = whole.groupBy("query_id").agg(F.sum("g").alias("gt"))
    mine = by_client.groupBy(client, "query_id").agg(F.sum("cnt").alias("ct"))
    # cells that a client lacks add their share of all: 1 less the shares of those it has
    seen = by_client.join(whole, ["query_id", "cell"]).join(totals, "query_id").join(mine, [client, "query_id"])
    p, q = F.col("cnt") / F.col("ct"), F.col("g") / F.col("gt")
    each = seen.groupBy(client, "query_id").agg((0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("tv"))
    clients = each.groupBy(client).agg(F.avg("tv").alias("tv"))
    return clients.agg(F.avg("tv").alias("mean"), F.stddev_pop("tv").alias("deviation"), F.min("tv").alias("least"), F.max("tv").alias("largest"))


def answer_bytes(domain: Domain, workload: Sequence[Query], spark) -> DataFrame:
    """(query_id, bytes) that a client sends for each answer: 8 a cell."""
    return spark.createDataFrame([(",".join(q), 8 * domain.size(q)) for q in workload], "query_id string, bytes bigint")


def communication_totals(messages: DataFrame) -> DataFrame:
    """(direction, per_client, total): sums of bytes by client, averaged, and of all, over messages
    (client_id, direction, bytes)."""
    each = messages.groupBy("client_id", "direction").agg(F.sum("bytes").alias("b"))
    return each.groupBy("direction").agg(F.avg("b").alias("per_client"), F.sum("b").cast("long").alias("total"))


def running_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, deviation (floored at 1e-3), least, largest, n; infinity where there are none."""
    inf = F.lit(float("inf"))
    m, s = F.avg(value), F.avg(F.col(value) * F.col(value))
    return df.agg(F.coalesce(m, inf).alias("mean"), F.coalesce(F.sqrt(s - m * m + 1e-6), inf).alias("deviation"), F.coalesce(F.min(value), inf).alias("least"), F.coalesce(F.max(value), inf).alias("largest"), F.count(value).alias("n"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the mean of each column."""
    return df.agg(*(F.avg(c).alias(c) for c in cols))


def class_distribution(df: DataFrame, *cols: str) -> DataFrame:
    """Rows by class: of a label, or of clients and labels."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def averaged(metrics: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Metrics of several seeds, averaged for each setting."""
    return metrics.groupBy(*by).agg(F.count("*").alias("seeds"), *(F.avg(c).alias(c) for c in cols))


def best_metric(metrics: DataFrame, group: str, metric: str, at: str) -> DataFrame:
    """(group, at, metric) of each group's largest metric, the earliest of equal ones; none that is null."""
    best = F.max_by(F.struct(at, metric), F.struct(F.col(metric), -F.col(at))).alias("_b")
    return metrics.where(F.col(metric).isNotNull()).groupBy(group).agg(best).select(group, f"_b.{at}", f"_b.{metric}")


def pending_jobs(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the mean over ends of jobs of how many were pending then, the ending one included; starts come
    first at equal times. Infinity without jobs. Summed over ends, pending jobs are the starts so far less the
    ends before, so two running numbers do."""
    events = jobs.select(F.col(start).alias("_t"), F.lit(1).alias("_s")).union(jobs.select(F.col(end), F.lit(0)))
    counted = running_sum(events.withColumn("_o", 1 - F.col("_s")), ["_t", "_o"], "_s", "_started")
    ended = running_sum(counted.withColumn("_e", 1 - F.col("_s")), ["_t", "_o"], "_e", "_ended")
    return ended.where("_s = 0").agg(F.coalesce(F.avg(F.col("_started") - F.col("_ended") + 1), F.lit(float("inf"))).alias("pending"))
