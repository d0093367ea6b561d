"""Joining rows that touch: gaps and islands on interval tables.

A row joins the row before it (ordered by start, then end) when that row's end
reaches its start. Only the previous row is looked at, not the furthest end so
far, so a nested interval can split an island. A NULL end never reaches
anything; by default it is also ignored when an island's end is taken, so an
open island is closed at its last known end (``keep_open_end`` changes that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmart.operators.hotkeys import HotKeys, both_paths, find_hot_keys, place_of
from spanmart.operators.ordinals import WINDOW_ROWS


def _value_columns(
    df: DataFrame,
    fixed: list[str],
    value_cols: list[str] | None,
    exclude_cols: list[str] | None,
) -> list[str]:
    if value_cols and exclude_cols:
        raise ValueError("give value_cols or exclude_cols, not both")
    if value_cols:
        return list(value_cols)
    skipped = {*fixed, *(exclude_cols or [])}
    found = [c for c in df.columns if c not in skipped]
    if not found:
        raise ValueError("no value columns are left")
    return found


def _continues(compare: list[str], prev_end: Column, start: Column, prev_values: Column) -> Column:
    reached = prev_end >= start
    if not compare:
        return reached
    # Equal values, where NULL equals NULL; a struct also allows mixed types.
    return reached & F.struct(*compare).eqNullSafe(prev_values)


def _new_island(continues: Column) -> Column:
    return F.when(continues, F.lit(0)).otherwise(F.lit(1))


def _lagged(compare: list[str], window) -> Column:
    return F.lag(F.struct(*compare)).over(window) if compare else F.lit(None)


def _local_islands(
    rows: DataFrame, group: list[str], compare: list[str], start: str, end: str
) -> DataFrame:
    """Rows with their island number inside ``group``."""
    window = Window.partitionBy(*group).orderBy(start, end, *compare)
    marked = rows.withColumn(
        "__new",
        _new_island(
            _continues(compare, F.lag(end).over(window), F.col(start), _lagged(compare, window))
        ),
    )
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("__island", F.sum("__new").over(running))


def _bounds(start: str, end: str) -> list[Column]:
    return [F.min(start).alias("__min"), F.max(end).alias("__max")]


def _finish(
    islands: DataFrame, out: list[str], start: str, end: str, keep_open_end: bool
) -> DataFrame:
    last = F.col("__max")
    if keep_open_end:
        last = F.when(~F.col("__open"), last)
    return islands.select(*out, F.col("__min").alias(start), last.alias(end))


def _flatten(
    df: DataFrame,
    keys: list[str],
    group: list[str],
    compare: list[str],
    start: str,
    end: str,
    out: list[str],
    keep_open_end: bool,
    hot_rows: int | None | HotKeys,
) -> DataFrame:
    df = df.select(*dict.fromkeys([*out, start, end]))
    # Keys alone are counted: when no key is hot, no (key, value) group is.
    hot = find_hot_keys([df], keys, hot_rows)
    islands = (
        _local_islands(hot.regular(df), group, compare, start, end)
        .groupBy(*group, *compare, "__island")
        .agg(*_bounds(start, end), F.max(F.col(end).isNull()).alias("__open"))
    )
    regular = _finish(islands, out, start, end, keep_open_end)
    if not hot.found:
        return regular
    sliced = _flatten_sliced(hot, df, group, compare, start, end)
    return both_paths(regular, _finish(sliced, out, start, end, keep_open_end))


def _flatten_sliced(
    hot: HotKeys, df: DataFrame, group: list[str], compare: list[str], start: str, end: str
) -> DataFrame:
    """Islands of hot keys: first inside each slice, then across slice borders.

    Slices are cut evenly in the order of the rows, by start, end and values.
    Copies of a row are combined before anything is brought together. After
    that only the first and the last island of a slice can touch a neighbour,
    so the second step brings at most two rows per slice of a key together.
    """
    order = [F.col(c) for c in (start, end, *compare)]
    place = place_of(df, start)
    cuts = hot.cuts(df, *order, place=place)
    distinct = (
        cuts.on(df)
        .groupBy(*dict.fromkeys([*group, *compare, start, end]), "__cut")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    rows = cuts.placed(distinct, "__slice", *order, place=place).select(*df.columns, "__slice")
    in_slice = [*group, "__slice"]
    window = Window.partitionBy(*in_slice).orderBy(start, end, *compare)
    numbered = (
        rows.withColumn("__rn", F.row_number().over(window))
        .withColumn("__tail", F.lead(F.lit(True)).over(window).isNull())
    )
    local = (
        _local_islands(numbered, in_slice, compare, start, end)
        .groupBy(*in_slice, *compare, "__island")
        .agg(
            *_bounds(start, end),
            F.max(F.col(end).isNull()).alias("__open"),
            F.min("__rn").alias("__rn"),
            F.min_by(start, "__rn").alias("__first_start"),
            F.max_by(end, "__rn").alias("__last_end"),
            F.max("__tail").alias("__tail"),
        )
        .withColumn("__head", F.col("__rn") == 1)
    )
    edge = F.col("__head") | F.col("__tail")
    local = local.withColumn("__side", F.when(edge, F.lit(-2)).otherwise(F.col("__slice")))
    across = Window.partitionBy(*group, "__side").orderBy("__slice", "__island")
    joined = F.col("__head") & F.lag("__tail").over(across) & _continues(
        compare, F.lag("__last_end").over(across), F.col("__first_start"), _lagged(compare, across)
    )
    running = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = (
        local.withColumn("__new", _new_island(joined))
        .withColumn("__whole", F.sum("__new").over(running))
        .groupBy(*group, *compare, "__side", "__whole")
        .agg(
            F.min("__min").alias("__min"),
            F.max("__max").alias("__max"),
            F.max("__open").alias("__open"),
        )
        .drop("__side", "__whole")
    )
    # A copy of an open or inverted row cannot join the copy before it.
    reaches_itself = F.coalesce(F.col(end) >= F.col(start), F.lit(False))
    extra = _repeat(distinct.filter(~reaches_itself), F.col("__copies") - 1).select(
        *group,
        *compare,
        F.col(start).alias("__min"),
        F.col(end).alias("__max"),
        F.col(end).isNull().alias("__open"),
    )
    return islands.unionByName(extra)


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, generated in blocks spread over the cluster."""
    block = 1 << 16
    blocks = F.sequence(F.lit(1), F.ceil(times / F.lit(block)).cast("long"))
    spread = df.filter(times > 0).withColumn("__block", F.explode(blocks))
    size = F.least(F.lit(block).cast("long"), times - (F.col("__block") - 1) * block)
    # By row and block: nearly every row has one block only.
    keys = [name for name, kind in df.dtypes if not kind.startswith("map")]
    return spread.repartition(*keys, "__block").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), size))
    )


def _sorted(df: DataFrame, cols: list[str], sort: bool) -> DataFrame:
    return df.orderBy(*cols) if sort else df


def flatten_sequential_rows(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    value_cols: list[str] | None = None,
    exclude_cols: list[str] | None = None,
    keep_open_end: bool = False,
    sort: bool = False,
    hot_rows: int | None | HotKeys = WINDOW_ROWS,
) -> DataFrame:
    """Merge a row into the one before it when they touch and all values agree.

    A different value in between keeps two equal periods apart. Columns in
    ``exclude_cols`` are neither compared nor returned.
    """
    _need_keys(keys)
    values = _value_columns(df, [*keys, start, end], value_cols, exclude_cols)
    out = [*keys, *values]
    flat = _flatten(df, keys, keys, values, start, end, out, keep_open_end, hot_rows)
    return _sorted(flat, [*keys, start], sort)


def flatten_sequential_rows_mixed_datatypes(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    value_cols: list[str] | None = None,
    exclude_cols: list[str] | None = None,
    preset_filter: Column | None = None,
    keep_open_end: bool = False,
    hot_rows: int | None | HotKeys = WINDOW_ROWS,
) -> DataFrame:
    """Merge touching rows of one key **and** value, whatever lies in between."""
    _need_keys(keys)
    values = _value_columns(df, [*keys, start, end], value_cols, exclude_cols)
    if preset_filter is not None:
        df = df.filter(preset_filter)
    group = [*keys, *values]
    return _flatten(df, keys, group, [], start, end, group, keep_open_end, hot_rows)


def flatten_sequential_rows_no_value_cols(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    keep_open_end: bool = False,
    sort: bool = False,
    hot_rows: int | None | HotKeys = WINDOW_ROWS,
) -> DataFrame:
    """Islands of coverage per key; values are ignored."""
    _need_keys(keys)
    flat = _flatten(df, keys, keys, [], start, end, list(keys), keep_open_end, hot_rows)
    return _sorted(flat, [*keys, start], sort)


def _need_keys(keys: list[str]) -> None:
    if not keys:
        raise ValueError("interval operators need at least one key column")
