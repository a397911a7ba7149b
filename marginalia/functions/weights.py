"""Weights of asynchronous updates, by how stale they are and how many examples they saw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(staleness: Column) -> Column:
    return F.lit(1.0)


def threshold(staleness: Column, cutoff: int, after: float) -> Column:
    """1 below the cutoff, ``after`` from it on."""
    return F.when(staleness < cutoff, 1.0).otherwise(after)


def polynomial(staleness: Column, exponent: float) -> Column:
    return 1.0 / F.pow(1.0 + staleness, F.lit(exponent))


def equal(examples: Column) -> Column:
    return F.lit(1.0)


def linear(examples: Column) -> Column:
    return examples.cast("double")


def root(examples: Column) -> Column:
    return F.sqrt(examples)


def logarithm(examples: Column) -> Column:
    return F.log10(1.0 + examples)


def combined(example_weight: Column, staleness_weight: Column) -> Column:
    return example_weight * staleness_weight
