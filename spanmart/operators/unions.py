"""Unions over named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanmart.operators.quality import contract_differences


def union_columns(
    left: DataFrame, right: DataFrame, cols: list[str], kind: str = "ALL"
) -> DataFrame:
    """Union of the named columns, in that order, whatever their order is in the inputs."""
    if kind.upper() not in ("ALL", "DISTINCT"):
        raise ValueError("kind must be 'ALL' or 'DISTINCT'")
    if not cols:
        raise ValueError("name the columns to union")
    for side, df in (("first", left), ("second", right)):
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"the {side} table lacks columns {missing}")
    stacked = left.select(*cols).unionByName(right.select(*cols))
    return stacked.distinct() if kind.upper() == "DISTINCT" else stacked


def union_territories(tables: list[DataFrame], contract: T.StructType) -> DataFrame:
    """Stack tables that all satisfy one contract; anything else is an error."""
    if not tables:
        raise ValueError("no tables to union")
    for number, df in enumerate(tables):
        problems = contract_differences(df.schema, contract)
        if problems:
            raise ValueError(f"table {number} breaks the contract: {problems}")
    names = contract.fieldNames()
    return reduce(DataFrame.unionByName, (df.select(*names) for df in tables))
