"""Rows from a graphical model, drawn in the cluster without a shuffle.

Rows are made in chunks of CHUNK, a task each. In a chunk, attributes are drawn one after the other given
their parents: the rows with equal parents, in random order, get the values by systematic sampling, the
r-th of n rows that in whose part of the cumulative shares (r + u) / n falls, u being one uniform number a
group. So in every chunk each value's count is its expectation rounded up or down. (Windows over groups of
equal parents say the same in SQL, but shuffle and sort all rows once an attribute.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.pgm import GraphicalModel

CHUNK = 1 << 17


def _dealt(key: np.ndarray, ends: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A value for each row, given its group's number and each group's cumulative shares."""
    n, size = len(key), ends.shape[1]
    order = rng.permutation(n)
    order = order[np.argsort(key[order], kind="stable")]
    sorted_key = key[order]
    starts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    counts = np.diff(np.append(starts, n))
    rank = np.arange(n) - np.repeat(starts, counts)
    at = (rank + np.repeat(rng.random(len(starts)), counts)) / np.repeat(counts, counts)
    # one sorted line of all groups' shares: group k's lie between k and k + 1
    line = (ends + np.arange(len(ends))[:, None]).ravel()
    value = np.searchsorted(line, sorted_key + at, side="right") - sorted_key * size
    out = np.empty(n, dtype=np.int64)
    out[order] = np.clip(value, 0, size - 1)
    return out


def rows(spark: SparkSession, model: GraphicalModel, n: int | None = None, seed: str | int = 0, decode: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """``n`` rows (the model's total if not given) with the domain's columns. ``decode`` has, for attributes whose
    codes stand for other values, the values of all codes but the last, and those that share the last. They depend on the model,
    n and the seed only; the tasks get the model's conditional tables, whose size its limit bounds."""
    n = max(0, round(model.total)) if n is None else n
    steps = []
    for attr, parents, shares in model.conditionals():
        ends = np.cumsum(shares.reshape(-1, shares.shape[-1]), axis=1)
        ends[:, -1] = 1.0
        steps.append((attr, parents, model.domain.project(parents).shape, ends))
    attrs = list(model.domain.attrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                size = min(CHUNK, n - chunk * CHUNK)
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{chunk}".encode()).digest()[:8], "big"))
                drawn: dict[str, np.ndarray] = {}
                for attr, parents, shape, ends in steps:
                    key = np.ravel_multi_index([drawn[p] for p in parents], shape) if parents else np.zeros(size, dtype=np.int64)
                    drawn[attr] = _dealt(key, ends, rng)
                for attr, (own, shared) in (decode or {}).items():
                    drawn[attr] = np.append(own, 0)[drawn[attr]] + np.where(drawn[attr] == len(own), shared[rng.integers(0, len(shared), size)], 0)
                yield pa.RecordBatch.from_arrays([pa.array(drawn[a].astype(np.int32)) for a in attrs], names=attrs)

    chunks = -(-n // CHUNK)
    made = spark.range(0, chunks, 1, max(1, chunks))
    return made.mapInArrow(run, ", ".join(f"`{a}` int" for a in attrs))
