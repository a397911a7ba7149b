"""Rows to clients (sharders) and clients to rounds (selectors).

Random choices are functions of a seed and keys (see functions.rng), so a client's rows and a round's
cohort don't depend on partitions. Orders over all rows are taken in ranges, never in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_uniform
from marginalia.operators.ordered import numbered

#: Rows of a key and a number, at most, that are sent to every task; more meet the other side in a shuffle.
MOST_SENT = 200_000


def iid(df: DataFrame, key: str, clients: int, seed: int) -> DataFrame:
    """Clients of equal size, give or take one, the larger first, in a random order of rows."""
    n = df.count()
    big, small = n % clients, n // clients
    edge = big * (small + 1)
    placed = numbered(df.withColumn("_u", keyed_uniform(seed, key)), [F.col("_u"), F.col(key)], "_place")
    client = F.when(F.col("_place") < edge, F.expr(f"_place div {small + 1}")).otherwise(big + F.expr(f"(_place - {edge}) div {max(small, 1)}"))
    return placed.withColumn("client_id", client.cast("int")).drop("_u", "_place")


def random(df: DataFrame, key: str, shards: int, seed: int) -> DataFrame:
    """Each key's rows to a random shard, but those of the first ``shards`` different keys to one each, so that
    none is empty if there are as many keys."""
    leading = df.select(key).distinct().orderBy(key).limit(shards)  # as many rows as shards
    leading = leading.select(F.col(key).alias("_lead"), (F.row_number().over(Window.orderBy(key)) - 1).cast("int").alias("_first"))
    drawn = F.floor(keyed_uniform(seed, key) * shards).cast("int")
    found = df.join(F.broadcast(leading) if shards <= MOST_SENT else leading, F.col(key).eqNullSafe(F.col("_lead")), "left")
    return found.withColumn("shard", F.coalesce("_first", drawn)).select(*df.columns, "shard")


def sequential(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``rows`` rows a shard, in order."""
    return numbered(df, [F.col(order)], "_place").withColumn("shard", F.expr(f"_place div {rows}").cast("int")).drop("_place")


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    return numbered(df, [F.col(order)], "_place").withColumn("shard", (F.col("_place") % shards).cast("int")).drop("_place")


def broadcasted(df: DataFrame, shards: int) -> DataFrame:
    """Every row to every shard."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def by_column(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("shard", F.col(col))


def by_weights(df: DataFrame, key: str, weights: Sequence[float], seed: int, name: str = "shard") -> DataFrame:
    """Each row to a shard with odds by weight: its uniform number falls into the shard's part of the
    cumulative weights, found by binary search in an array of one number a shard."""
    ends = np.cumsum(np.asarray(weights, dtype=float))
    ends = (ends / ends[-1]).tolist()
    listed = F.array(*(F.lit(float(e)) for e in ends[:-1]))
    n = len(ends) - 1
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))))
    u = keyed_uniform(seed, key)
    if not n:
        return df.withColumn(name, F.lit(0))
    with_u = df.withColumn("_u", u)
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.element_at(listed, F.least(at + s, F.lit(n))) <= F.col("_u")), at + s).otherwise(at))
    return with_u.withColumn(name, found.cast("int")).drop("_u")


def power_law_weights(shards: int, alpha: float) -> np.ndarray:
    return (np.arange(1, shards + 1) / shards) ** (alpha - 1)


def zipf_weights(shards: int, a: float) -> np.ndarray:
    w = 1.0 / np.arange(1, shards + 1) ** a
    return w / w.sum()


def sample_skew(df: DataFrame, key: str, clients: int, a: float, seed: int) -> DataFrame:
    """Client sizes by a Zipf law."""
    return by_weights(df, key, zipf_weights(clients, a), seed, "client_id")


def dirichlet_sizes(total: int, shares: Sequence[float]) -> np.ndarray:
    """Whole sizes that sum to ``total``, one a client, from its shares: cut down, at least 1, and what is
    then missing goes to the first smallest, what is too much comes off the largest ones. With fewer rows
    than clients the first clients have one row each."""
    n = len(shares)
    if total <= n:
        return (np.arange(n) < total).astype(np.int64)
    sizes = np.maximum((np.asarray(shares, dtype=float) * total).astype(np.int64), 1)
    short = total - sizes.sum()
    if short > 0:
        sizes[sizes.argmin()] += short
    while short < 0:
        k = sizes.argmax()
        taken = min(-short, sizes[k] - 1)
        sizes[k] -= taken
        short += taken
    return sizes


def _class_counts(df: DataFrame, label: str) -> list[tuple]:
    """(number, rows) of each class in ascending order; the classes themselves stay where they are."""
    found = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).select("n").toArrow()  # a number a class
    return list(enumerate(found.column("n").to_pylist()))


def by_sizes(df: DataFrame, key: str, label: str | None, counts: Sequence[tuple], sizes: Sequence[np.ndarray], seed: int) -> DataFrame:
    """The rows of each class, in a random order, to clients of the given sizes one after the other.
    ``counts`` has (class, rows) in ascending order, nulls first; without a label all rows are one class. A row's
    place among all of them, in the order of classes, says both its class and its client: tasks find it by binary search
    among the ends of all shares, 8 bytes for each class and client."""
    clients = len(sizes[0]) if len(sizes) else 1
    own = np.array(sizes, dtype=np.int64).reshape(-1, clients)
    starts = np.append(0, np.cumsum([n for _, n in counts], dtype=np.int64))[: len(own)]
    ends = df.sparkSession.sparkContext.broadcast((starts[:, None] + np.cumsum(own, axis=1)).ravel())

    @F.pandas_udf("int")
    def client(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(ends.value, place.to_numpy(), side="right") % clients).astype(np.int32))

    order = [*([F.col(label).asc_nulls_first()] if label else []), F.col("_u"), F.col(key)]
    placed = numbered(df.withColumn("_u", keyed_uniform(seed, key)), order, "_place")
    return placed.withColumn("client_id", client("_place")).select(*df.columns, "client_id")


def label_skew(df: DataFrame, key: str, label: str, clients: int, beta: float, seed: int) -> DataFrame:
    """Each label's rows to clients by Dirichlet proportions of its own, in whole sizes of at least one
    row. Proportions are drawn on the driver from the seed, label after label in ascending order."""
    rng = np.random.default_rng(seed)
    counts = _class_counts(df, label)
    sizes = [dirichlet_sizes(n, rng.dirichlet(np.full(clients, beta))) for _, n in counts]
    return by_sizes(df, key, label, counts, sizes, seed)


def capped_sizes(counts: Sequence[int], clients: int, beta: float, seed: int, tries: int = 10_000) -> list[np.ndarray]:
    """Sizes by class and client: proportions of a class count only for clients that hold less than an equal
    part of all rows so far; drawn anew until every client has two rows."""
    rng, total = np.random.default_rng(seed), sum(counts)
    if total < 2 * clients:
        raise ValueError(f"{total} rows do not give {clients} clients two each")
    for _ in range(tries):
        held, out = np.zeros(clients, dtype=np.int64), []
        for n in counts:
            shares = rng.dirichlet(np.full(clients, beta)) * (held < total / clients)
            if not shares.sum():  # all that is drawn is with clients that are full
                break
            cuts = (np.cumsum(shares / shares.sum()) * n).astype(np.int64)
            cuts[-1] = n
            out.append(np.diff(cuts, prepend=0))
            held += out[-1]
        else:
            if held.min() >= 2:
                return out
    raise ValueError(f"no split with two rows for each of {clients} clients in {tries} draws")


def label_skew_capped(df: DataFrame, key: str, label: str, clients: int, beta: float, seed: int) -> DataFrame:
    """Label skew in which clients that are full take no more rows (see capped_sizes)."""
    counts = _class_counts(df, label)
    return by_sizes(df, key, label, counts, capped_sizes([n for _, n in counts], clients, beta, seed), seed)


def sample_skew_dirichlet(df: DataFrame, key: str, clients: int, beta: float, seed: int) -> DataFrame:
    """Client sizes by Dirichlet proportions of all rows, at least one each."""
    total = df.count()
    shares = np.random.default_rng(seed).dirichlet(np.full(clients, beta))
    return by_sizes(df, key, None, [(None, total)], [dirichlet_sizes(total, shares)], seed)


_METHOD = re.compile(r"(debug_label_skew|zipf_sample_skew|dirch_label_skew|dirch_sample_skew|cluster)(?:.*?beta=([0-9.]+))?")


def parse_method(text: str) -> tuple[str, float | None]:
    """(kind of skew, beta) of a name such as ``dirch_label_skew_beta=0.5``."""
    found = _METHOD.match(text)
    if not found:
        raise ValueError(f"unknown split: {text}")
    return found[1], float(found[2]) if found[2] else None


def vertical(df: DataFrame, parts: int, seed: int) -> list[DataFrame]:
    """Columns dealt into ``parts`` groups of equal size, give or take one."""
    order = np.random.default_rng(seed).permutation(df.columns).tolist()
    return [df.select(*map(str, p)) for p in np.array_split(order, parts)]


def train_test(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: about ``share`` of the rows, and the rest."""
    u = keyed_uniform(seed, key)
    return df.where(u < share), df.where(u >= share)


def batches(df: DataFrame, group: str, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds the number of the batch of ``size`` rows within each group."""
    w = Window.partitionBy(group)
    out = df.withColumn("batch", F.expr(f"(row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1) div {size}"))
    return out.withColumn("_n", F.count("*").over(w)).where((F.col("batch") + 1) * size <= F.col("_n")).drop("_n") if drop_last else out


# -- cohorts ---------------------------------------------------------------------------------


def poisson(clients: DataFrame, q: float, rounds: DataFrame, seed: int, key: str = "client_id") -> DataFrame:
    """(round, client) of each round's cohort: every client with probability q."""
    return rounds.crossJoin(clients.select(key)).where(keyed_uniform(seed, "round", key) < q).select("round", key)


def uniform(clients: DataFrame, per_round: int, rounds: DataFrame, seed: int, key: str = "client_id") -> DataFrame:
    """``per_round`` distinct clients a round: the least by a hash of round and client."""
    ranked = rounds.crossJoin(clients.select(key)).withColumn("_u", keyed_uniform(seed, "round", key))
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy("round").orderBy("_u", key))).where(F.col("_r") <= per_round).select("round", key)


def round_robin_cohorts(clients: DataFrame, per_round: int, seed: int, epoch: int = 0, key: str = "client_id") -> DataFrame:
    """Every client once an epoch, in a random order, ``per_round`` a round."""
    placed = numbered(clients.select(key).withColumn("_u", keyed_uniform(seed, F.lit(epoch), key)), ["_u", key], "_place")
    return placed.select(F.expr(f"_place div {per_round}").alias("round"), key)


def importance(clients: DataFrame, per_round: int, seed: int, rounds: DataFrame, key: str = "client_id", size: str = "n") -> DataFrame:
    """Every client with probability n * per_round / (sum of n)."""
    whole = F.broadcast(clients.agg(F.sum(size).alias("_all")))  # one row
    odds = clients.crossJoin(whole).withColumn("_p", F.col(size) * per_round / F.col("_all"))
    return rounds.crossJoin(odds).where(keyed_uniform(seed, "round", key) < F.col("_p")).select("round", key)


def capped(cohorts: DataFrame, most: int, key: str = "client_id") -> DataFrame:
    """The first ``most`` rounds of each client."""
    return cohorts.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("round"))).where(F.col("_k") <= most).drop("_k")


def users_per_round(start: int, gamma: float, milestones: Sequence[int], round_: int) -> int:
    """Cohort sizes that change by ``gamma`` at milestones."""
    return max(1, int(start * gamma ** sum(round_ >= m for m in milestones)))


def to_probability(utilities: DataFrame, zero_share: float, temperature: float, key: str = "client_id", utility: str = "utility") -> DataFrame:
    """(client, p): softmax of temperature * utility over all but the lowest ``zero_share`` of clients."""
    n = utilities.count()
    ranked = numbered(utilities, [F.col(utility), F.col(key)], "_place")
    top = F.broadcast(utilities.agg(F.max(utility).alias("_m")))  # one row
    raw = ranked.crossJoin(top).withColumn("_e", F.when(F.col("_place") < int(zero_share * n), 0.0).otherwise(F.exp(temperature * (F.col(utility) - F.col("_m")))))
    whole = F.broadcast(raw.agg(F.sum("_e").alias("_s")))
    return raw.crossJoin(whole).select(key, (F.col("_e") / F.col("_s")).alias("p"))


def dense_ids(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a column numbered in ascending order."""
    return numbered(df.select(col).distinct(), [col], name)


def by_clusters(df: DataFrame, features: Sequence[str], clients: int, components: int = 2, seed: int = 0) -> DataFrame:
    """Feature skew: each row to the client of its cluster, by k-means on the leading principal
    components of the scaled features. (Neighbour embeddings before clustering are not available.)"""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    steps = [
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
        PCA(k=min(components, len(features)), inputCol="_z", outputCol="_p"),
        KMeans(k=clients, seed=seed, featuresCol="_p", predictionCol="client_id", maxIter=20),
    ]
    return Pipeline(stages=steps).fit(df).transform(df).drop("_x", "_z", "_p")
