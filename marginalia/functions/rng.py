"""Random columns.

``keyed_uniform`` is a function of a seed and keys: it can be replayed, in any engine that has md5, and
doesn't depend on partitions or on tasks that run again. Whoever knows the seed knows the noise, so for a
real release the seed must be secret and random; ``secret_seed`` draws one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def secret_seed() -> str:
    return secrets.token_hex(16)


def keyed_uniform(seed: str | int, *keys: Column | str) -> Column:
    """A number strictly between 0 and 1 for each value of the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def keyed_normal(seed: str | int, *keys: Column | str) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = keyed_uniform(f"{seed}a", *keys), keyed_uniform(f"{seed}b", *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def keyed_laplace(seed: str | int, *keys: Column | str) -> Column:
    """Laplace of scale 1, by its inverse distribution function."""
    u = keyed_uniform(seed, *keys) - 0.5
    return -F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))


def keyed_gumbel(seed: str | int, *keys: Column | str) -> Column:
    return -F.log(-F.log(keyed_uniform(seed, *keys)))


def keyed_exponential(seed: str | int, *keys: Column | str) -> Column:
    return -F.log(keyed_uniform(seed, *keys))
