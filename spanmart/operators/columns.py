"""Projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the columns in ``names``, in that order, under their new names."""
    missing = [c for c in names if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def star_except(df: DataFrame, cols: list[str]) -> DataFrame:
    """All columns but some; an empty result is an error."""
    kept = [c for c in df.columns if c not in set(cols)]
    if not kept:
        raise ValueError("no columns are left")
    return df.select(*kept)


def filter_rows(df: DataFrame, condition: Column | None) -> DataFrame:
    """Optional filter, for operators that take a caller's predicate."""
    return df if condition is None else df.filter(condition)
