"""Joins on equal keys and overlapping time.

The plain plan is a hash- or sort-merge join on the keys with the time
condition as a residual. It compares every pair of rows of one key, which is
fine for small keys only. Hot keys are swept by start instead. Of rows that share
some time, one starts last, and all others cover that start: so each table in
turn gives the points, cut into even cells of its own starts, and every
other table's intervals are filed under the cells they touch. A cell's rows
meet by equality on key and cell, the time condition is checked exactly, and all
tables of one turn share that partitioning. An interval has a copy for each cell
it covers, whose points all lie inside it: copies follow the size of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmart.functions.predicates import (
    far_future_for,
    intervals_overlap,
    merged_interval_above,
    merged_interval_below,
)
from spanmart.operators.hotkeys import BINS, Cuts, HotKeys, both_paths, find_hot_keys, place_of
from spanmart.operators.ordinals import WINDOW_ROWS, running_ordinal

# Up to this many rows, comparing a key's rows pairwise beats the extra shuffles
# of the other way.
PAIR_ROWS = 2_000


def key_condition(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (left[k] == right[prefix + k] for k in keys))


def stab_join(
    points: DataFrame,
    point: str,
    others: list[tuple[DataFrame, Column, Column, bool, str]],
    keys: list[str],
    cuts: Cuts,
) -> DataFrame:
    """Rows of hot keys with the intervals of every other table that cover their ``point``.

    ``others`` holds (table, start, end, strict, how): ``start <= point < end``, or ``start < point`` where
    strict; a NULL bound is open; ``how`` is 'inner' or 'left'. Columns other than the keys must differ
    between the tables. The result has all columns of ``points`` and those of the others without the keys.
    """
    names = list(points.columns)
    kind = points.schema[point].dataType
    others = [
        (df.withColumns({"__start": start, "__end": end}), *rest) for df, start, end, *rest in others
    ]
    # Buckets and bins need one number line.
    if any(df.schema[c].dataType != kind for df, *_ in others for c in ("__start", "__end")):
        cuts = cuts.by_value()
    joined = cuts.celled(cuts.on(points), "__cell", F.col(point), place_of(points, point)).drop("__cut")
    for df, strict, how in others:
        values = [c for c in df.columns if c not in {*keys, "__start", "__end"}]
        filed = cuts.on(df).filter(F.coalesce(F.col("__start") < F.col("__end"), F.lit(True)))
        for bound, cell in (("__start", "__first"), ("__end", "__last")):
            filed = cuts.celled(filed, cell, F.col(bound), place_of(filed, bound))
        first = F.when(F.col("__start").isNull(), F.lit(0)).otherwise(F.col("__first"))
        last = F.when(F.col("__end").isNull(), cuts.last_cell()).otherwise(F.col("__last"))
        filed = filed.select(
            *[F.col(k).alias(f"__i_{k}") for k in keys],
            *values,
            "__start",
            "__end",
            # Never empty; an outer explode infers no filter, which would evaluate the cells again below.
            F.explode_outer(F.sequence(first.cast("long"), last.cast("long"))).alias("__i_cell"),
        )
        begun = F.col("__start") < F.col(point) if strict else F.col("__start") <= F.col(point)
        meets = (
            key_condition(joined, filed, keys, "__i_")
            & (joined["__cell"] == filed["__i_cell"])
            & (begun | F.col("__start").isNull())
            & ((F.col(point) < F.col("__end")) | F.col("__end").isNull())
        )
        names += values
        joined = joined.join(filed, meets, how).select(*names, "__cell")
    return joined.select(*names)


def start_cuts(hot: HotKeys, df: DataFrame, start: str, rows: int | None = None) -> Cuts:
    """Cells of even numbers of starts."""
    known = df.filter(F.col(start).isNotNull())
    return hot.cuts(known, F.col(start), rows=rows, place=place_of(df, start), bins=BINS)


def _check_names(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    if not keys:
        raise ValueError("interval joins need at least one key column")
    shared = {c for c in left.columns if c in right.columns} - set(keys)
    if shared:
        raise ValueError(f"rename the columns both sides have: {sorted(shared)}")


def _unmatched(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    l_start: str,
    l_last: Column,
    r_start: str,
    r_last: Column,
    hot: HotKeys,
) -> DataFrame:
    """Left rows of hot keys that no right row overlaps, without looking at pairs.

    A partner starts before the row's end and ends after its start; so the furthest end among all right
    rows that start before the row's end decides. That is a running maximum over narrow bounds, carried
    from slice to slice.
    """
    plain = [F.col(k).alias(k) for k in keys]
    ends = right.select(*plain, F.col(r_start).alias("__at"), r_last.alias("__reach")).filter(
        F.col("__at").isNotNull()
    )
    asked = left.select(*plain, l_last.alias("__at")).filter(F.col("__at").isNotNull())
    # Equal bounds are combined before the shuffle: a sentinel end is asked about once per key.
    ends = ends.groupBy(*keys, "__at").agg(F.max("__reach").alias("__reach"))
    asked = asked.distinct()
    both = ends.withColumn("__asks", F.lit(False)).unionByName(
        asked.withColumns({"__asks": F.lit(True), "__reach": F.lit(None)})
    )
    cuts = start_cuts(hot, right, r_start).by_value()
    events = cuts.placed(cuts.on(both), "__slice", F.col("__at")).drop("__cut")
    # At one instant the question comes first: a partner starts strictly before the end.
    in_slice = Window.partitionBy(*keys, "__slice").orderBy("__at", F.col("__asks").desc())
    walked = events.withColumn("__seen", F.max("__reach").over(in_slice))
    carried = events.groupBy(*keys, "__slice").agg(F.max("__reach").alias("__most"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, "__slice"]
    carried = carried.select(
        *[F.col(c).alias(f"__c_{c}") for c in on], F.max("__most").over(before).alias("__earlier")
    )
    answers = walked.filter("__asks").join(carried, key_condition(walked, carried, on, "__c_"))
    answers = answers.select(
        *[F.col(k).alias(f"__q_{k}") for k in keys],
        F.col("__at").alias("__q_at"),
        F.greatest("__seen", "__earlier").alias("__furthest"),
    )
    rows = left.withColumn("__at", l_last)
    same = key_condition(rows, answers, keys, "__q_") & (rows["__at"] == answers["__q_at"])
    found = rows.join(answers, same, "left")
    lonely = ~F.coalesce(F.col("__furthest") > F.col(l_start), F.lit(False))
    return found.filter(lonely).select(*left.columns)


def interval_overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    l_start: str,
    l_end: str,
    r_start: str,
    r_end: str,
    how: str = "inner",
    far_future: object = None,
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Rows with equal keys whose [start, end) overlap; a NULL end is open."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    _check_names(left, right, keys)
    l_last = F.coalesce(F.col(l_end), far_future_for(left, l_end, far_future))
    r_last = F.coalesce(F.col(r_end), far_future_for(right, r_end, far_future))
    hot = find_hot_keys([left, right], keys, hot_rows)
    regular = hot.regular(left)
    names = [*left.columns, *[c for c in right.columns if c not in keys]]
    other = hot.regular(right).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    meets = key_condition(regular, other, keys, "__r_") & (
        (F.col(l_start) < r_last) & (F.col(r_start) < l_last)
    )
    regular = regular.join(other, meets, how).select(*names)
    if not hot.found:
        return regular
    hot_left, hot_right = hot.hot(left), hot.hot(right)
    sliced = overlap_pairs(left, right, keys, l_start, l_last, r_start, r_last, hot).select(*names)
    if how == "left":
        lonely = _unmatched(hot_left, hot_right, keys, l_start, l_last, r_start, r_last, hot)
        sliced = sliced.unionByName(lonely, allowMissingColumns=True)
    return both_paths(regular, sliced)


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    l_start: str,
    l_last: Column,
    r_start: str,
    r_last: Column,
    hot: HotKeys,
) -> DataFrame:
    """Pairs of hot keys with ``l_start < r_last and r_start < l_last``.

    Bounds are compared pairwise, so an empty interval strictly inside another one still overlaps it.
    """
    left, right = left.withColumn("__l_last", l_last), right.withColumn("__r_last", r_last)
    by_right = stab_join(
        right, r_start, [(left, F.col(l_start), F.col("__l_last"), False, "inner")], keys, start_cuts(hot, right, r_start)
    )
    by_left = stab_join(
        left, l_start, [(right, F.col(r_start), F.col("__r_last"), True, "inner")], keys, start_cuts(hot, left, l_start)
    )
    both = by_right.filter(F.col(l_start) < F.col("__r_last")).unionByName(
        by_left.filter(F.col(r_start) < F.col("__l_last"))
    )
    return both.drop("__l_last", "__r_last")


def point_in_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    start_default: object,
    how: str = "inner",
    far_future: object = None,
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Rows with equal keys where ``point`` lies in [start, end).

    A NULL start counts as ``start_default``, a NULL end as the far future.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    _check_names(points, intervals, keys)
    first = F.coalesce(F.col(start), far_future_for(intervals, start, start_default))
    last = F.coalesce(F.col(end), far_future_for(intervals, end, far_future))
    hot = find_hot_keys([points, intervals], keys, hot_rows)
    regular = hot.regular(points)
    values = [c for c in intervals.columns if c not in keys]
    other = hot.regular(intervals).select(*[F.col(k).alias(f"__r_{k}") for k in keys], *values)
    meets = (
        key_condition(regular, other, keys, "__r_")
        & (first <= F.col(point))
        & (F.col(point) < last)
    )
    regular = regular.join(other, meets, how).select(*points.columns, *values)
    if not hot.found:
        return regular
    # A point has one place, so that the join itself keeps those without an interval.
    cuts = start_cuts(hot, points, point)
    sliced = stab_join(points, point, [(intervals, first, last, False, how)], keys, cuts)
    return both_paths(regular, sliced.select(*points.columns, *values))


def extend_back(
    df: DataFrame,
    belows: list[str],
    id_col: str,
    primary_below: str,
    name: str,
    tie_break: list[str] | None = None,
    hot_rows: int | None | HotKeys = WINDOW_ROWS,
) -> DataFrame:
    """Lower end of the common interval, the first one of each id pulled back.

    The first interval of an id (by the lower end) starts at ``primary_below``.
    """
    lowered = df.withColumn("__lower", merged_interval_below(belows))
    order = ["__lower", *(tie_break or [])]
    numbered = running_ordinal(lowered, [id_col], order, "__nth", hot_rows)
    start = F.when(F.col("__nth") == 1, F.col(primary_below)).otherwise(F.col("__lower"))
    return numbered.withColumn(name, start).drop("__lower", "__nth")


def common_interval_join(
    tables: list[tuple[DataFrame, str, str]],
    keys: list[str],
    start_name: str = "interval_start",
    end_name: str = "interval_end",
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Inner join of two or more interval tables on keys and common time.

    ``tables`` holds (table, start column, end column). A NULL bound is open
    and does not limit the common interval. Column names other than the keys
    must differ between the tables. The common interval is added in two columns.
    Rows that no table bounds on some side at all are left out.
    """
    if len(tables) < 2:
        raise ValueError("common_interval_join needs at least two tables")
    hot = find_hot_keys([df for df, _, _ in tables], keys, hot_rows)
    joined, start, end = tables[0]
    joined = hot.regular(joined)
    starts, ends = [start], [end]
    for other, o_start, o_end in tables[1:]:
        _check_names(joined, other, keys)
        values = [c for c in other.columns if c not in keys]
        other = hot.regular(other).select(*[F.col(k).alias(f"__r_{k}") for k in keys], *values)
        starts, ends = [*starts, o_start], [*ends, o_end]
        # Open on all sides so far: a later table may still bound the interval.
        common = F.coalesce(intervals_overlap(starts, ends), F.lit(True))
        meets = key_condition(joined, other, keys, "__r_") & common
        joined = joined.join(other, meets).select(*joined.columns, *values)
    if hot.found:
        joined = both_paths(joined, _common_by_start(tables, keys, hot).select(*joined.columns))
    joined = joined.filter(intervals_overlap(starts, ends))
    return joined.withColumns(
        {start_name: merged_interval_below(starts), end_name: merged_interval_above(ends)}
    )


def _common_by_start(
    tables: list[tuple[DataFrame, str, str]], keys: list[str], hot: HotKeys
) -> DataFrame:
    """Combinations of hot keys, each found at the table whose row starts last (the first one of equals).

    Bounds are the tables' own: an open one is NULL and never stands for a value. A row that starts last
    has a start, else no row of the combination has one and it is left out in any case.
    """
    turns = []
    for i, (points, start, end) in enumerate(tables):
        proper = F.col(end).isNull() | (F.col(start) < F.col(end))
        points = points.filter(F.col(start).isNotNull() & proper)
        others = [
            (df, F.col(o_start), F.col(o_end), j < i, "inner")
            for j, (df, o_start, o_end) in enumerate(tables)
            if j != i
        ]
        turns.append(stab_join(points, start, others, keys, start_cuts(hot, points, start)))
    return reduce(DataFrame.unionByName, turns)
