"""Data-quality checks: each returns the failing rows, so empty means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Non-NULL values seen more than once, with their count."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_records"))
    return counts.filter(F.col("n_records") > 1)


def check_accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Values outside the list, with their count. NULL is not a value, in the list neither."""
    values = [v for v in values if v is not None]
    outside = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
    return outside.groupBy(col).agg(F.count(F.lit(1)).alias("n_records"))


def check_relationship(
    child: DataFrame, col: str, parent: DataFrame, parent_col: str
) -> DataFrame:
    """Child rows whose non-NULL key is absent from the parent."""
    known = parent.select(F.col(parent_col).alias("__known"))
    rows = child.filter(F.col(col).isNotNull())
    return rows.join(known, rows[col] == known["__known"], "left_anti")


def check_expression(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is false; NULL passes."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~condition)


def contract_differences(
    actual: T.StructType, contract: T.StructType
) -> list[tuple[str, str, str | None, str | None]]:
    """(column, problem, expected type, actual type) for every mismatch."""
    want = {f.name: f.dataType.simpleString() for f in contract.fields}
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    missing = [(n, "missing", t, None) for n, t in want.items() if n not in have]
    extra = [(n, "unexpected", None, t) for n, t in have.items() if n not in want]
    wrong = [(n, "type", t, have[n]) for n, t in want.items() if n in have and have[n] != t]
    return missing + wrong + extra


def check_contract(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Differences between a table's schema and its contract, one row each."""
    return df.sparkSession.createDataFrame(
        contract_differences(df.schema, contract),
        "column_name string, problem string, expected_type string, actual_type string",
    )


def contract_failures(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Differences from the contract, and how many rows lack a value it requires.

    A field of the contract that is not nullable must have a value in every row; all of them are counted in
    one pass. ``n_rows`` is NULL for differences of the schema.
    """
    shape = check_contract(df, contract).withColumn("n_rows", F.lit(None).cast("long"))
    needed = [f for f in contract.fields if not f.nullable and f.name in df.columns]
    if not needed:
        return shape
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.lit("null").alias("problem"),
                    F.lit(f.dataType.simpleString()).alias("expected_type"),
                    F.lit(df.schema[f.name].dataType.simpleString()).alias("actual_type"),
                    F.count_if(F.col(f.name).isNull()).alias("n_rows"),
                )
                for f in needed
            ]
        ).alias("found")
    )
    return shape.unionByName(counts.select(F.inline("found")).filter(F.col("n_rows") > 0))


def source_freshness(df: DataFrame, loaded_at: str, source: str | None = None) -> DataFrame:
    """Newest load time of a source."""
    newest = df.agg(F.max(loaded_at).alias("max_loaded_at"))
    return newest if source is None else newest.select(F.lit(source).alias("source"), "max_loaded_at")
