"""Federated mechanisms: local selection and measurement with a server's model, and local generators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.rng import keyed_gumbel, keyed_normal
from marginalia.operators import marginals, shard, workload
from marginalia.operators.workload import Query
from marginalia.plans import accounting
from marginalia.plans.mechanisms import Result, allowed
from marginalia.plans.pgm import Measurement, estimate


def model_answers(spark, model, work: Sequence[Query]) -> DataFrame:
    """(query_id, cell, m): the model's shares of every cell."""
    rows = [(marginals.name(q), k, float(v)) for q, f in model.many(work).items() for k, v in enumerate(f.flat() / model.total)]
    return spark.createDataFrame(rows, "query_id string, cell bigint, m double")


def local_aim(df: DataFrame, client: str, domain: Domain, work: Sequence[Query], eps: float, delta: float, rounds: int, q: float, seed: int = 0, megabytes: float = 80.0, iterations: int = 100, final: int = 300, correct_skew: bool = True) -> Result:
    """AIM with local selection: in each round a Poisson cohort of clients each chooses, privately, the query that the
    server's model answers worst for its own rows, measures it with its share of the noise, and the
    server merges the measurements by query, weighted by rows, and fits its model again.

    With ``correct_skew`` a client's score of a query is lowered by how far its own single attributes are
    from the noisy ones of all (its skew), so that it doesn't choose queries only for being unlike others.
    Clients' answers are one table by client; scores, choices and noise of a round are one plan over it,
    and the sums per chosen query come to the driver.
    """
    from marginalia.operators.ordered import numbered as in_order

    spark = df.sparkSession
    closed = workload.closure(work)
    weights = workload.scores(work)
    ones = [c for c in closed if len(c) == 1]
    ids = in_order(df.select(F.col(client).alias("client_id")).distinct(), ["client_id"], "_c").persist()
    count = ids.count()
    coded = df.join(ids, df[client] == ids["client_id"]).select("_c", *domain.attrs)
    held = marginals.marginals(coded, domain, closed, "_c", count).persist()
    sizes = held.where(F.col("query_id") == marginals.name(ones[0])).groupBy("_c").agg(F.sum("cnt").alias("n")).persist()
    cohorts = shard.poisson(ids.select("_c"), q, spark.range(rounds + 1).withColumnRenamed("id", "round"), seed, "_c").persist()
    ledger = accounting.Ledger(eps, delta)
    share = ledger.rho / (rounds + 1)
    sigma_ones, sigma, choice = accounting.gaussian_sigma(share, len(ones)), accounting.gaussian_sigma(0.9 * share), accounting.exponential_epsilon(0.1 * share)

    def merged(chosen: DataFrame, deviation: float, t: int) -> list[Measurement]:
        """Noisy sums of the chosen (client, query) answers, scaled to all rows."""
        rows = int(sizes.agg(F.sum("n")).first()[0])
        own = held.join(chosen, ["_c", "query_id"]).join(sizes, "_c")
        by_query = chosen.join(sizes, "_c").groupBy("query_id").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
        asked = [query for query in closed if marginals.name(query) in {r.query_id for r in by_query}]
        full = marginals.all_cells(spark, domain, asked).join(own.groupBy("query_id", "cell").agg(F.sum("cnt").alias("cnt")), ["query_id", "cell"], "left")
        noise = {r.query_id: deviation * math.sqrt(r.k) for r in by_query}  # each client adds its own
        scale = F.lit(0.0)
        for name, s in noise.items():
            scale = F.when(F.col("query_id") == name, s).otherwise(scale)
        noisy = full.select("query_id", "cell", (F.coalesce("cnt", F.lit(0)) + scale * keyed_normal(f"{seed}|{t}", "query_id", "cell")).alias("y"))
        answers = {query: np.zeros(domain.size(query)) for query in asked}
        names = {marginals.name(query): query for query in asked}
        for r in noisy.toLocalIterator():
            answers[names[r.query_id]][r.cell] = r.y
        return [Measurement(names[r.query_id], answers[names[r.query_id]] * rows / r.n, noise[r.query_id] * rows / r.n) for r in by_query]

    def everyone(t: int) -> DataFrame:
        own = cohorts.where(F.col("round") == t).select("_c")
        return own if own.count() else ids.select("_c")

    try:
        started = everyone(0).crossJoin(F.broadcast(workload.as_frame(spark, ones).select("query_id")))
        measured = merged(started, sigma_ones, 0)
        for _ in ones:
            ledger.gaussian(sigma_ones)
        model = estimate(domain, measured, iterations=iterations)
        chosen_all: list[Query] = []
        for t in range(1, rounds + 1):
            usable = [c for c in allowed(closed, model, domain, megabytes * (t + 1) / (rounds + 1)) if len(c) > 1] or closed
            m = F.broadcast(model_answers(spark, model, usable))  # bounded by the model's limit
            mine = held.join(everyone(t), "_c", "left_semi").join(sizes, "_c")
            # |x - m| summed over all cells: cells without rows of the client add the model's share
            gap = mine.join(m, ["query_id", "cell"]).groupBy("_c", "query_id").agg((F.sum(F.abs(F.col("cnt") / F.col("n") - F.col("m"))) + 1 - F.sum("m")).alias("gap"), F.first("n").alias("n"))
            info = F.broadcast(spark.createDataFrame([(marginals.name(c), float(weights[c]), float(domain.size(c)), list(c)) for c in usable], "query_id string, w double, cells double, attrs array<string>"))
            scored = gap.join(info, "query_id")
            if correct_skew:
                base = F.broadcast(model_answers(spark, model, ones))
                skew = held.where(F.col("query_id").isin([marginals.name(o) for o in ones])).join(everyone(t), "_c", "left_semi").join(sizes, "_c").join(base, ["query_id", "cell"]).groupBy("_c", F.col("query_id").alias("a")).agg((F.sum(F.abs(F.col("cnt") / F.col("n") - F.col("m"))) + 1 - F.sum("m")).alias("s"))
                penalty = scored.select("_c", "query_id", F.explode("attrs").alias("a")).join(skew, ["_c", "a"]).groupBy("_c", "query_id").agg(F.avg("s").alias("skew"))
                scored = scored.join(penalty, ["_c", "query_id"])
            else:
                scored = scored.withColumn("skew", F.lit(0.0))
            score = F.col("w") * (F.col("n") * (F.col("gap") - F.col("skew")) - math.sqrt(2 / math.pi) * sigma * F.col("cells"))
            top = max(weights[c] for c in usable)
            picked = scored.groupBy("_c").agg(F.max_by("query_id", score * (choice / (2 * top)) + keyed_gumbel(f"{seed}|{t}", "_c", "query_id")).alias("query_id")).persist()
            fresh = merged(picked, sigma, t)
            picked.unpersist()
            ledger.exponential(choice)
            ledger.gaussian(sigma)
            chosen_all += [x.query for x in fresh]
            measured += fresh
            model = estimate(domain, measured, iterations=final if t == rounds else iterations, warm=model)
        return Result(model, ledger, chosen_all)
    finally:
        for frame in (ids, held, sizes, cohorts):
            frame.unpersist()


def local_aim_start(df: DataFrame, client: str, domain: Domain, work: Sequence[Query], eps: float, delta: float, q: float, seed: int = 0) -> Result:
    """Only the first step: all budget on single attributes."""
    return local_aim(df, client, domain, work, eps, delta, 0, q, seed)


def local_generators(df: DataFrame, client: str, domain: Domain, eps: float, seed: int = 0) -> DataFrame:
    """Rows that each client makes from its own noisy single attributes, all together. A client's rows
    are one group in a Python worker: clients are devices, small by nature."""
    attrs, shape = list(domain.attrs), list(domain.shape)

    def make(part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(part["client_id"].iloc[0]) & 0x7FFFFFFF])
        n, out = len(part), {"client_id": np.full(len(part), part["client_id"].iloc[0])}
        for a, size in zip(attrs, shape):
            x = np.bincount(np.clip(part[a].to_numpy(int), 0, size - 1), minlength=size) + rng.laplace(0, len(attrs) / eps, size)
            x = np.maximum(x, 0)
            out[a] = rng.choice(size, n, p=x / x.sum() if x.sum() > 0 else None)
        return pd.DataFrame(out)

    schema = "client_id bigint, " + ", ".join(f"`{a}` int" for a in attrs)
    rows = df.select(F.col(client).cast("bigint").alias("client_id"), *attrs)
    return rows.groupBy("client_id").applyInPandas(make, schema)


def central_equivalent(df: DataFrame, domain: Domain, work: Sequence[Query]) -> DataFrame:
    """What all clients' answers sum to."""
    return marginals.marginals(df, domain, work)
