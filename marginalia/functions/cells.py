"""Cells of a contingency table as numbers, and small numeric functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(attrs: Sequence[str], shape: Sequence[int]) -> Column:
    """Row-major index of the attributes' values."""
    out = F.lit(0).cast("long")
    for a, n in zip(attrs, shape):
        out = out * n + F.col(a).cast("long")
    return out


def coordinates(index: str, attrs: Sequence[str], shape: Sequence[int]) -> list[Column]:
    """The values that a row-major index stands for."""
    out, step = [], 1
    for a, n in reversed(list(zip(attrs, shape))):
        out.append(F.pmod(F.expr(f"{index} div {step}"), F.lit(n)).cast("int").alias(a))
        step *= n
    return out[::-1]


def cantor_pair(a: Column, b: Column) -> Column:
    """A number for each pair of non-negative whole numbers."""
    a, b = a.cast("long"), b.cast("long")
    s = a + b
    return F.shiftright(s * (s + 1), 1) + b


def equal_width_bin(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Right-closed bins of equal width over [low, high]; the lowest edge belongs to bin 0.
    Null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.ceil((x - low) / ((high - low) / bins)) - 1)).cast("int")
