"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    value_cols: list[str],
    method: str = "MAX",
    skip_nulls: bool = False,
) -> DataFrame:
    """One row per key: the values at the max (or min) of the ordering tuple.

    The ordering columns of that row are returned as well. With ``skip_nulls``
    each value column takes its own latest non-NULL value. A single order
    column ignores rows where it is NULL; a tuple ranks NULL lowest. Aggregates
    combine map-side, so a key may hold any share of the rows.
    """
    if method not in ("MAX", "MIN"):
        raise ValueError(f"method must be 'MAX' or 'MIN', got {method!r}")
    if not keys or not order_cols:
        raise ValueError("distinct_on needs keys and order columns")
    pick = F.max_by if method == "MAX" else F.min_by
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    orders_only = [o for o in order_cols if o not in value_cols]
    if not skip_nulls:
        # One aggregate for the whole row, so that ties cannot mix rows.
        row = F.struct(*value_cols, *orders_only)
        picked = df.groupBy(*keys).agg(pick(row, order).alias("__row"))
        return picked.select(
            *keys, *[F.col("__row").getField(c).alias(c) for c in [*value_cols, *orders_only]]
        )
    # A NULL order is ignored by max_by/min_by, which is how rows with a NULL
    # value are left out for that column only.
    values = [pick(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in value_cols]
    orders = [pick(F.col(o), order).alias(o) for o in orders_only]
    return df.groupBy(*keys).agg(*values, *orders)


def keep_latest(
    df: DataFrame,
    key: str | list[str] = "unique_id",
    order_desc: str | list[str | Column] = "generated_at",
) -> DataFrame:
    """Newest row per key.

    The rank filter becomes a group limit that keeps one row per key and input
    partition before the shuffle, so hot keys do not reach the reducer whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order_desc] if isinstance(order_desc, str) else list(order_desc)
    newest_first = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("__row_num", ranked).filter(F.col("__row_num") == 1).drop("__row_num")
