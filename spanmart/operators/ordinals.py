"""Running row numbers per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmart.operators.hotkeys import HotKeys, both_paths, find_hot_keys, place_of

# A sort of this many narrow rows is comfortable for one task.
WINDOW_ROWS = 2_000_000


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType)


def tie_break(df: DataFrame) -> Column:
    """A hash of the whole row, by which rows of one order are told apart."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not _has_map(f.dataType)])


def running_ordinal(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    name: str,
    hot_rows: int | None | HotKeys = WINDOW_ROWS,
) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … by ``order_cols`` (NULLs first).

    Give order columns that are unique per key for a repeatable result. Keys
    above ``hot_rows`` are cut into even slices by all order columns and, among
    ties, by a hash of the row; rows are numbered inside slices, then shifted
    by the row count of the earlier slices.
    """
    if not keys or not order_cols:
        raise ValueError("running_ordinal needs keys and order columns")
    hot = find_hot_keys([df], keys, hot_rows)
    by_key = Window.partitionBy(*keys).orderBy(*order_cols)
    regular = hot.regular(df).withColumn(name, F.row_number().over(by_key).cast("long"))
    if not hot.found:
        return regular

    order = [*[F.col(c) for c in order_cols], tie_break(df)]
    place = place_of(df, order_cols[0])
    cuts = hot.cuts(df, *order, place=place)
    # Keys may be NULL: a struct of them is never NULL and compares NULL-safe,
    # so windows and the join below share one partitioning.
    rows = cuts.placed(cuts.on(df), "__slice", *order, place=place).withColumn("__key", F.struct(*keys))
    counts = rows.groupBy("__key", "__slice").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "__key", "__slice", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset")
    )
    in_slice = Window.partitionBy("__key", "__slice").orderBy(*order_cols)
    numbered = rows.withColumn("__local", F.row_number().over(in_slice))
    sliced = numbered.join(offsets, ["__key", "__slice"]).select(
        *df.columns, (F.col("__offset") + F.col("__local")).alias(name)
    )
    return both_paths(regular, sliced)
