"""Federated updates as long tables (client_id, idx, v): reducers, channels, secure sums, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.rng import keyed_normal, keyed_uniform
from marginalia.operators.ordered import numbered


def from_vectors(df: DataFrame, client: str, vector: str) -> DataFrame:
    """Arrays to one row a component."""
    return df.select(F.col(client).alias("client_id"), F.posexplode(vector).alias("idx", "v")).withColumn("v", F.col("v").cast("double"))


def reduced(updates: DataFrame, weights: DataFrame | None = None, how: str = "average") -> DataFrame:
    """(idx, v) over clients: ``sum``, ``average``, ``weighted_sum`` or ``weighted_average`` with weights
    (client_id, weight). A total weight that is not positive gives 0."""
    if how in ("sum", "average"):
        return updates.groupBy("idx").agg((F.sum if how == "sum" else F.avg)("v").alias("v"))
    both = updates.join(weights, "client_id")
    top, total = F.sum(F.col("weight") * F.col("v")), F.sum("weight")
    if how == "weighted_sum":
        return both.groupBy("idx").agg(top.alias("v"))
    if how == "weighted_average":
        return both.groupBy("idx").agg(F.when(total > 0, top / total).otherwise(0.0).alias("v"))
    raise ValueError(f"unknown reducer: {how}")


def clipped(updates: DataFrame, most: float) -> DataFrame:
    """Each client's vector scaled to a norm of at most ``most``."""
    norms = updates.groupBy("client_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
    return updates.join(norms, "client_id").select("client_id", "idx", (F.col("v") * F.least(F.lit(1.0), most / (F.col("_norm") + 1e-10))).alias("v"))


def private_average(updates: DataFrame, clients: int, clip: float, noise: float, seed) -> DataFrame:
    """Clip, average, and add normal noise of deviation clip * noise / clients."""
    mean = clipped(updates, clip).groupBy("idx").agg((F.sum("v") / clients).alias("v"))
    return mean.select("idx", (F.col("v") + clip * noise / clients * keyed_normal(seed, "idx")).alias("v"))


def private_weighted(updates: DataFrame, weights: DataFrame, clip: float, low: float, high: float, noise: float, mean_weight: float, clients: int, seed, how: str = "unbiased") -> DataFrame:
    """Weighted private average: weights are clamped to [low, high]. ``sum`` has sensitivity clip * high;
    ``unbiased`` divides by the expected weight clients * mean_weight, ``biased`` by clients * low."""
    kept = weights.select("client_id", F.least(F.greatest("weight", F.lit(low)), F.lit(high)).alias("weight"))
    total = reduced(clipped(updates, clip), kept, "weighted_sum")
    over = {"sum": 1.0, "unbiased": clients * mean_weight, "biased": clients * low}[how]
    scale = clip * high * noise / over
    return total.select("idx", (F.col("v") / over + scale * keyed_normal(seed, "idx")).alias("v"))


def next_clip(clip: float, noisy_share: float, quantile: float, rate: float, low: float = 1e-8, high: float = 1e8) -> float:
    """The adaptive clipping bound after a round in which ``noisy_share`` were not clipped."""
    import math

    return min(max(clip * math.exp(-rate * (noisy_share - quantile)), low), high)


def quantised(updates: DataFrame, bits: int = 8, symmetric: bool = False) -> DataFrame:
    """Round trip through whole numbers of ``bits`` bits, with each client's own range."""
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if symmetric else (0, (1 << bits) - 1)
    span = updates.groupBy("client_id").agg(F.least(F.min("v"), F.lit(0.0)).alias("_a"), F.greatest(F.max("v"), F.lit(0.0)).alias("_b"))
    if symmetric:
        step, zero = F.greatest(F.abs("_a"), F.abs("_b")) / high, F.lit(0.0)
    else:
        step = (F.col("_b") - F.col("_a")) / (high - low)
        zero = low - F.rint(F.col("_a") / F.col("_s"))
    sized = updates.join(span, "client_id").withColumn("_s", F.when(step > 0, step).otherwise(1.0)).withColumn("_z", zero)
    q = F.least(F.greatest(F.rint(F.col("v") / F.col("_s")) + F.col("_z"), F.lit(float(low))), F.lit(float(high)))
    return sized.withColumn("_q", q).select("client_id", "idx", ((F.col("_q") - F.col("_z")) * F.col("_s")).alias("v"), F.col("_q").cast("long").alias("q"))


def top_k_masked(updates: DataFrame, sparsity: float) -> DataFrame:
    """Sets the int(sparsity * n) components of least magnitude of each client to 0."""
    order = Window.partitionBy("client_id").orderBy(F.abs("v"), "idx")
    n = F.count("*").over(Window.partitionBy("client_id"))
    return updates.withColumn("_r", F.row_number().over(order)).withColumn("_n", n).select("client_id", "idx", F.when(F.col("_r") <= F.floor(sparsity * F.col("_n")), 0.0).otherwise(F.col("v")).alias("v"))


def random_masked(updates: DataFrame, sparsity: float, seed) -> DataFrame:
    """The same with components drawn at random, equal for all clients of a seed."""
    shared = updates.select("idx").distinct().withColumn("_u", keyed_uniform(seed, "idx"))
    ranked = numbered(shared, ["_u", "idx"], "_r")
    size = F.broadcast(ranked.agg(F.count("*").alias("_n")))  # one row
    dropped = ranked.crossJoin(size).where(F.col("_r") < F.floor(sparsity * F.col("_n"))).select("idx", F.lit(0.0).alias("_zero"))
    return updates.join(dropped, "idx", "left").select("client_id", "idx", F.coalesce("_zero", "v").alias("v"))


def message_bytes(updates: DataFrame, how: str = "identity", sparsity: float = 0.0) -> DataFrame:
    """(client_id, bytes) of a message: floats of 4 bytes, halves of 2, 8-bit integers with scale and zero,
    or a sparse message, the smaller of a coordinate list and a bit mask."""
    sizes = updates.groupBy("client_id").agg(F.count("*").alias("n"))
    kept = F.col("n") - F.floor(sparsity * F.col("n"))
    cost = {"identity": F.col("n") * 4, "half": F.col("n") * 2, "int8": F.col("n") + 8, "sparse": F.least(kept * (4 + 8), kept * 4 + F.ceil(F.col("n") / 8))}[how]
    return sizes.select("client_id", cost.cast("long").alias("bytes"))


def to_fixed(v: Column, scale: float, size: int) -> Column:
    """Scaled, clamped and rounded (half to even) to a signed whole number of ``size`` bytes."""
    low, high = float(-(1 << (8 * size - 1))), float((1 << (8 * size - 1)) - 1)
    return F.rint(F.greatest(F.lit(low), F.least(F.lit(high), v * scale))).cast("long")


def to_float(c: Column, scale: float) -> Column:
    return c.cast("double") / scale


def wrapped(total: Column, size: int) -> Column:
    """A sum as the truncated remainder in the range of ``size`` bytes."""
    high = 1 << (8 * size - 1)
    return F.when(total >= 0, total % high).otherwise(total % F.lit(-high))


def secure_sum(updates: DataFrame, scale: float, client_bytes: int, sum_bytes: int) -> DataFrame:
    """(idx, fixed, v, overflowed): clients' fixed-point numbers summed, wrapped and turned back."""
    limit = (1 << (8 * client_bytes - 1)) - 1
    fixed = updates.select("idx", to_fixed(F.col("v"), scale, client_bytes).alias("f"), F.when((F.col("v") * scale > limit) | (F.col("v") * scale < -limit - 1), 1).otherwise(0).alias("o"))
    sums = fixed.groupBy("idx").agg(F.sum("f").alias("s"), F.sum("o").alias("overflowed"))
    return sums.select("idx", wrapped(F.col("s"), sum_bytes).alias("fixed"), to_float(wrapped(F.col("s"), sum_bytes), scale).alias("v"), "overflowed")


def diversity(updates: DataFrame) -> DataFrame:
    """One row: norm_of_sum (squared), sum_of_norms (squared), gradient diversity and orthogonality."""
    by_idx = updates.groupBy("idx").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    both = by_idx.agg(F.sum(F.col("s") * F.col("s")).alias("norm_of_sum"), F.sum("q").alias("sum_of_norms"))
    return both.select("norm_of_sum", "sum_of_norms", (F.col("sum_of_norms") / F.col("norm_of_sum")).alias("diversity"), (F.col("sum_of_norms") / (F.col("norm_of_sum") - F.col("sum_of_norms"))).alias("orthogonality"))


def combined(a: DataFrame, wa: float, b: DataFrame, wb: float, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """wa * a + wb * b of two models (idx, v), or of as many as further ``keys`` tell apart."""
    return a.join(b.withColumnRenamed("v", "_b"), list(keys)).select(*keys, (wa * F.col("v") + wb * F.col("_b")).alias("v"))


def trust_ratio(weights: DataFrame, gradients: DataFrame, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(layer, ratio): norm of weights over norm of gradients of each layer; 1 where either is 0."""
    w = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("w"))
    g = gradients.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("g"))
    return w.join(g, list(keys)).select(*keys, F.when((F.col("w") > 0) & (F.col("g") > 0), F.col("w") / F.col("g")).otherwise(1.0).alias("ratio"))


def running_average(measured: DataFrame) -> DataFrame:
    """(query_id, round, v): measurements (query_id, round, n, v) merged by sample counts up to a round."""
    w = Window.partitionBy("query_id", "cell").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return measured.select("query_id", "cell", "round", (F.sum(F.col("v") * F.col("n")).over(w) / F.sum("n").over(w)).alias("v"))
