"""Sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_seed(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header. Types are declared, or inferred for small files.

    Doubled quotes inside quoted fields are read as one quote.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    # The declared names win over the file's, whose case may differ.
    return reader.option("enforceSchema", True).schema(schema).csv(path)


def read_table(spark: SparkSession, place: str, name: str) -> DataFrame:
    """A named source table: ``<place>/<name>.parquet``, or ``place.name`` in the catalog."""
    if "/" in place:
        return spark.read.parquet(f"{place.rstrip('/')}/{name}.parquet")
    return spark.table(f"{place}.{name}" if place else name)


def values(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Relation from literal rows."""
    return spark.createDataFrame(rows, schema)
