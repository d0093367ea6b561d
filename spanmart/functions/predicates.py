"""Predicates and bounds on validity intervals ([start, end), NULL end = open)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmart.functions.dates import FAR_FUTURE, as_col


def far_future_for(df: DataFrame, col: str, far_future: object = None) -> Column:
    """The open-end sentinel, typed like the interval column it stands in for."""
    dtype = df.schema[col].dataType
    return F.lit(FAR_FUTURE if far_future is None else far_future).cast(dtype)


def date_between(
    date: Column | str,
    below: Column | str,
    above: Column | str,
    start_default: Column,
    end_default: Column | None = None,
) -> Column:
    """``date`` lies in [below, above); NULL bounds take the defaults."""
    date = as_col(date)
    end_default = F.lit(FAR_FUTURE).cast("timestamp") if end_default is None else end_default
    return (F.coalesce(as_col(below), start_default) <= date) & (
        date < F.coalesce(as_col(above), end_default)
    )


def _extreme(pick, cols: list[Column | str]) -> Column:
    if not cols:
        raise ValueError("at least one interval bound is needed")
    cols = [as_col(c) for c in cols]
    return cols[0] if len(cols) == 1 else pick(*cols)


def merged_interval_above(aboves: list[Column | str]) -> Column:
    """Upper end of the common part of several intervals (NULLs are skipped)."""
    return _extreme(F.least, aboves)


def merged_interval_below(
    belows: list[Column | str],
    extend_back: bool = False,
    id_col: str | None = None,
    primary_below: str | None = None,
) -> Column:
    """Lower end of the common part of several intervals (NULLs are skipped).

    With ``extend_back`` the first interval of each ``id_col`` starts at
    ``primary_below`` instead. That form is a window over ``id_col``;
    ``operators.interval_joins.extend_back`` does the same without one.
    """
    lower = _extreme(F.greatest, belows)
    if not extend_back:
        return lower
    if id_col is None or primary_below is None:
        raise ValueError("extend_back needs id_col and primary_below")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(lower)) == 1
    return F.when(first, F.col(primary_below)).otherwise(lower)


def intervals_overlap(belows: list[Column | str], aboves: list[Column | str]) -> Column:
    """True when all the intervals share some time."""
    return merged_interval_below(belows) < merged_interval_above(aboves)


def all_not_null(cols: list[Column | str]) -> Column:
    return reduce(and_, (as_col(c).isNotNull() for c in cols))


def any_not_null(cols: list[Column | str]) -> Column:
    return reduce(or_, (as_col(c).isNotNull() for c in cols))


def equals_any(col: Column | str, values: list) -> Column:
    """Equal to one of the values; NULL values in the list match nothing."""
    return as_col(col).isin([v for v in values if v is not None])
