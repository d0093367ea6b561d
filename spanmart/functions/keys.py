"""Derived keys and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmart.functions.dates import as_col

# Fixed value: stands for NULL inside a surrogate key.
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: Column | str) -> Column:
    """md5 of the columns' text, joined by '-'; NULL has its own token."""
    if not cols:
        raise ValueError("surrogate_key needs at least one column")
    parts = [F.coalesce(as_col(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    return F.md5(F.concat_ws("-", *parts).cast("binary"))


def composite_key(*cols: Column | str, sep: str = ".") -> Column:
    """Dotted text key; NULL when any part is NULL."""
    if not cols:
        raise ValueError("composite_key needs at least one column")
    parts = [as_col(c).cast("string") for c in cols]
    joined = reduce(lambda acc, part: [*acc, F.lit(sep), part], parts[1:], [parts[0]])
    return F.concat(*joined)


def membership_id(group: Column | str, user: Column | str, direct: Column | str) -> Column:
    """sha2-256 over group, user and the direct flag; a NULL flag is skipped."""
    blank = F.lit("")
    return F.sha2(
        F.concat_ws(
            "||",
            F.coalesce(as_col(group), blank),
            F.coalesce(as_col(user), blank),
            as_col(direct).cast("string"),
        ),
        256,
    )


def row_id() -> Column:
    """Unique, non-consecutive row number; not stable between runs."""
    return F.monotonically_increasing_id()


def flag(condition: Column) -> Column:
    """Condition as a boolean that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def label(condition: Column, if_true: str, otherwise: str) -> Column:
    """Label for a flag; a NULL flag takes the second label."""
    return F.when(condition, F.lit(if_true)).otherwise(F.lit(otherwise))
