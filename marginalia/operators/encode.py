"""Columns of a table to categorical codes, and the domain that they span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.domain import Domain
from marginalia.functions.cells import equal_width_bin
from marginalia.operators.ordered import numbered


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The given columns in the given order; all of them must be there."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*cols)


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a SQL predicate holds."""
    return df.where(predicate)


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``{c}_low`` and ``{c}_high`` of each column: its active domain."""
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "low"), (F.max, "high"))))


def discretise(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Replaces numeric columns by their equal-width bin over the column's range; 0 or fewer bins leave
    a column as it is. The ranges are taken in one pass for all columns and stand in the plan as
    numbers, so that filters on bins reach the scan. Nulls stay null; a column with one value is all in
    bin 0."""
    on = {c: n for c, n in bins.items() if n > 0}
    if not on:
        return df
    found = ranges(df, list(on)).first()
    made = {}
    for c, n in on.items():
        low, high = found[f"{c}_low"], found[f"{c}_high"]
        if low is None or low == high:
            made[c] = F.when(F.col(c).isNotNull(), 0)
        else:
            made[c] = equal_width_bin(F.col(c), float(low), float(high), n)
    return df.withColumns(made)


def codes_sorted(df: DataFrame, col: str) -> DataFrame:
    """(value, code): places of the distinct values in ascending order; nulls get no code."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return numbered(values, ["value"], "code")


def factorise_sorted(df: DataFrame, col: str, code: str | None = None) -> DataFrame:
    """Adds the code of each value in ascending order of values; -1 for null."""
    codes = codes_sorted(df, col).withColumnRenamed("code", "_code")
    return df.join(codes, df[col] == codes["value"], "left").withColumn(code or f"{col}_code", F.coalesce("_code", F.lit(-1))).drop("value", "_code")


def factorise_first_seen(df: DataFrame, col: str, row_id: str, code: str | None = None) -> DataFrame:
    """Adds the code of each value in the order in which ``row_id`` first shows it; -1 for null."""
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(row_id).alias("_first"))
    codes = numbered(first, ["_first"], "_code").select("value", "_code")
    return df.join(codes, df[col] == codes["value"], "left").withColumn(code or f"{col}_code", F.coalesce("_code", F.lit(-1))).drop("value", "_code")


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A stable number for each row: its place, from 1, among all rows sorted by all columns."""
    return numbered(df, df.columns, "_k").withColumn(name, F.col("_k") + 1).drop("_k")


def value_map(df: DataFrame, col: str, mapping: dict, default=None) -> DataFrame:
    """Replaces values by a given mapping; others become ``default``."""
    if not mapping:
        return df.withColumn(col, F.lit(default))
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(col, F.coalesce(pairs[F.col(col)], F.lit(default)))


def within(df: DataFrame, domain: Domain) -> DataFrame:
    """The domain's columns, of rows that have them all."""
    return df.select(*domain.attrs).dropna("any")


def infer_domain(df: DataFrame, label: str | None = None) -> Domain:
    """Largest code plus one of each integer column; for the label how many values it has."""
    rows = df.agg(*((F.countDistinct(c) if c == label else F.max(c) + 1).alias(c) for c in df.columns)).first()
    return Domain.of({c: int(rows[c] or 1) for c in df.columns})


def one_hot(col: str, size: int) -> Column:
    """An array of ``size`` zeros with a one at the column's value."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.col(col), 1).otherwise(0))


def one_hot_row(domain: Domain) -> Column:
    """The attributes' one-hot arrays side by side."""
    return F.concat(*(one_hot(a, n) for a, n in domain.config.items()))


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Features and label."""
    return df.drop(label), df.select(label)
