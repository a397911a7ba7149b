"""Tables with a domain: files with a sidecar, histograms, and generated rows."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import coordinates
from marginalia.functions.rng import keyed_normal, keyed_uniform
from marginalia.operators import encode
from marginalia.operators.ordered import running_sum

#: Separators of named tables that don't use a comma, and their label columns; fixed values.
SEPARATORS = {"marketing": ";"}
LABELS = {"adult": "income>50K", "marketing": "y", "covtype": "cover_type"}
BINS = 32


@dataclass
class Tabular:
    """An encoded table: integer columns, their domain and the label."""

    df: DataFrame
    domain: Domain
    label: str | None = None


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of any store that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def encoded(df: DataFrame, sizes: dict[str, int], label: str | None = None, bins: int = BINS) -> Tabular:
    """Columns of ``sizes`` of rows that have them all; size -1 is continuous and cut into ``bins``;
    text columns get codes in ascending order of their values. Codes beyond a size are left as they
    are: histograms drop them."""
    out = df.select(*sizes).dropna("any")
    kinds = dict(out.dtypes)
    for c in sizes:
        if kinds[c] in ("string", "boolean"):
            out = encode.factorise_sorted(out, c, "_new").drop(c).withColumnRenamed("_new", c)
    continuous = {c: bins for c, n in sizes.items() if n == -1 and c != label}
    out = encode.discretise(out.select(*sizes), continuous)
    final = {c: bins if c in continuous else n for c, n in sizes.items()}
    unknown = [c for c, n in final.items() if n == -1]
    if unknown:
        found = out.agg(*(F.max(c).alias(c) for c in unknown)).first()
        final |= {c: int(found[c] or 0) + 1 for c in unknown}
    return Tabular(out.select(*(F.col(c).cast("int").alias(c) for c in final)), Domain.of(final), label)


def named_csv(spark: SparkSession, root: str, name: str, bins: int = BINS) -> Tabular:
    """``{root}/{name}.csv`` with the sizes of ``{name}-domain.json``; without one, every column is
    continuous but the label, the last one unless the name is known."""
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", SEPARATORS.get(name, ",")).csv(f"{root}/{name}.csv")
    label = LABELS.get(name, df.columns[-1])
    try:
        sizes = json.loads(read_text(spark, f"{root}/{name}-domain.json"))
    except Exception as e:  # only a missing sidecar means that sizes are to be inferred
        if "PATH_NOT_FOUND" not in str(e):
            raise
        sizes = {c: -1 for c in df.columns}
    return encoded(df, sizes, label, bins)


def by_metadata(df: DataFrame, metadata: dict[str, str], label: str | None = None, bins: int = BINS) -> Tabular:
    """Columns by their kind: numerical ones are cut into bins, categorical, boolean and datetime ones
    get codes, ids are dropped."""
    kept = [c for c in df.columns if metadata.get(c) in ("numerical", "categorical", "boolean", "datetime")]
    out = df.select(*kept).dropna("any")
    for c in kept:
        if metadata[c] != "numerical":
            out = encode.factorise_sorted(out, c, "_new").drop(c).withColumnRenamed("_new", c)
    return _with_sizes(out.select(*kept), {c: metadata[c] == "numerical" for c in kept}, label, bins)


def _with_sizes(df: DataFrame, numerical: dict[str, bool], label: str | None, bins: int) -> Tabular:
    cut = encode.discretise(df, {c: bins for c, n in numerical.items() if n})
    found = cut.agg(*(F.max(c).alias(c) for c, n in numerical.items() if not n)).first() if not all(numerical.values()) else {}
    sizes = {c: bins if n else int(found[c] or 0) + 1 for c, n in numerical.items()}
    return Tabular(cut.select(*(F.col(c).cast("int").alias(c) for c in sizes)), Domain.of(sizes), label)


def histogram_file(spark: SparkSession, path: str) -> DataFrame:
    """(cell, cnt) of a text file with one count per line. Lines are numbered within the file, which is
    read whole: a histogram of a bounded domain."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")).alias("cell", "c")).select(F.col("cell").cast("long").alias("cell"), F.col("c").cast("double").cast("long").alias("cnt"))


def uniform_rows(spark: SparkSession, domain: Domain, n: int, seed: str | int = 0) -> DataFrame:
    """``n`` rows, every attribute uniform and independent."""
    return spark.range(n).select(*(F.floor(keyed_uniform(f"{seed}{a}", "id") * size).cast("int").alias(a) for a, size in domain.config.items()))


def zipf_clients(spark: SparkSession, clients: int, rows: int, attrs: int, a: float, size: int, seed: str | int = 0) -> DataFrame:
    """``rows`` rows for each client: every attribute is a normal number around a mean of the client's
    own, drawn from a Zipf law over 1 to size, cut to whole numbers."""
    w = 1.0 / np.arange(1, size + 1) ** a
    ends = np.cumsum(w / w.sum()).tolist()
    listed = F.array(*(F.lit(float(e)) for e in ends[:-1]))
    base = spark.range(clients * rows).select("id", F.expr(f"CAST(id div {rows} AS INT)").alias("client_id"))
    out = []
    for k in range(attrs):
        u = keyed_uniform(f"{seed}m{k}", "client_id")
        mean = 1 + F.size(F.filter(listed, lambda e: e <= F.col(f"_u{k}")))
        value = F.floor(mean + keyed_normal(f"{seed}v{k}", "id"))
        base = base.withColumn(f"_u{k}", u)
        out.append(F.least(F.greatest(value, F.lit(0)), F.lit(size)).cast("int").alias(str(k)))
    return base.select("client_id", *out)


def sparse_zipf_histogram(spark: SparkSession, n: int, cells: int, filled: float, power: float, seed: int = 0) -> DataFrame:
    """(cell, cnt): ``n`` draws by a Zipf law over a random part of the cells."""
    rng = np.random.default_rng(seed)
    support = rng.permutation(cells)[: max(1, round(cells * filled))]
    p = 1.0 / np.arange(1, len(support) + 1) ** power
    counts = rng.multinomial(n, p / p.sum())
    return spark.createDataFrame([(int(c), int(k)) for c, k in zip(support, counts) if k], "cell bigint, cnt bigint")


def with_coordinates(counts: DataFrame, attrs: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """A histogram's cells as named attributes."""
    return counts.select(*coordinates("cell", list(attrs), list(shape)), "cnt")


def exponential_fill(n: int, total: int, p: float) -> list[int]:
    """``n`` counts that fall by a factor of 1 - p each and sum to ``total``."""
    raw = np.array([p * (1 - p) ** k for k in range(n)])
    exact = raw / raw.sum() * total
    out = np.floor(exact).astype(int)
    out[np.argsort(out - exact, kind="stable")[: total - out.sum()]] += 1
    return out.tolist()


def uniformity(spark: SparkSession, share: float, cells: int, total: int, seed: int = 0) -> DataFrame:
    """(cell, cnt): a share of the cells, drawn at random, with equal counts."""
    k = max(1, round(share * cells))
    chosen = spark.range(cells).withColumn("_u", keyed_uniform(seed, "id")).orderBy("_u", "id").limit(k)
    return chosen.select(F.col("id").alias("cell"), F.lit(total // k).cast("long").alias("cnt"))


def sampled(counts: DataFrame, n: int, seed: str | int = 0) -> DataFrame:
    """(cell, cnt): ``n`` draws with replacement from a histogram, by where each draw's uniform number
    falls in the running shares; the lookup is a join on a bucket of the shares, not on all cells."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    if not total:
        return counts.limit(0)
    spans = running_sum(counts.where("cnt > 0").select("cell", "cnt"), ["cell"], "cnt", "_end").withColumn("_start", F.col("_end") - F.col("cnt"))
    width = max(1, total // 4096)
    listed = spans.withColumn("_k", F.explode(F.sequence(F.expr(f"_start div {width}"), F.expr(f"(_end - 1) div {width}"))))
    draws = spark.range(n).select(F.floor(keyed_uniform(seed, "id") * total).cast("long").alias("_x")).withColumn("_k", F.expr(f"_x div {width}"))
    hit = draws.join(listed, "_k").where((F.col("_x") >= F.col("_start")) & (F.col("_x") < F.col("_end")))
    return hit.groupBy("cell").agg(F.count("*").alias("cnt"))


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order."""
    return df.orderBy(order).limit(n)


def fraction(df: DataFrame, key: str, share: float, seed: int = 1034) -> DataFrame:
    """An exact share of the rows, by a hash of their key."""
    n = math.floor(df.count() * share + 0.5)
    return df.withColumn("_u", keyed_uniform(seed, key)).orderBy("_u", key).limit(n).drop("_u")
