"""Metric queries: dimensions, time grains, relative filters, sort and limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
GRAINS = ("HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
DEFAULT_LIMIT = 500
_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str
    expr: str

    def column(self) -> Column:
        if self.kind not in _KINDS:
            raise ValueError(f"metric kind must be one of {sorted(_KINDS)}, got {self.kind!r}")
        return _KINDS[self.kind](F.expr(self.expr)).alias(self.name)


def metric(name: str, kind: str, expr: str) -> Metric:
    """A sum, min or max over a column or SQL expression."""
    found = Metric(name, kind, expr)
    if kind not in _KINDS:
        raise ValueError(f"metric kind must be one of {sorted(_KINDS)}, got {kind!r}")
    return found


def time_dimension(col: str, grain: str) -> Column:
    """A timestamp truncated to a grain, named ``<col>_<grain>``."""
    if grain.upper() not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    return F.date_trunc(grain, F.col(col)).alias(f"{col}_{grain.lower()}")


def in_the_past(col: str, days: int, now: Column | None = None, grain: str | None = None) -> Column:
    """``col`` lies in the last ``days`` days up to ``now`` (injectable).

    With ``grain`` the column is truncated before it is compared.
    """
    now = F.current_timestamp() if now is None else now
    value = F.col(col) if grain is None else F.date_trunc(grain, F.col(col))
    return (value >= now - F.make_dt_interval(F.lit(days))) & (value <= now)


def metric_query(
    df: DataFrame,
    dims: list[Column | str],
    metrics: list[Metric],
    filters: list[Column] | None = None,
    sorts: list[tuple[str, bool]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, group, aggregate, then sort and limit.

    ``sorts`` holds (output column, descending). Without a limit all groups
    are returned; with one and a sort it runs as a per-partition top-k, not a full sort.
    """
    if not metrics:
        raise ValueError("metric_query needs at least one metric")
    for condition in filters or []:
        df = df.filter(condition)
    out = df.groupBy(*dims).agg(*[m.column() for m in metrics])
    if sorts:
        out = out.orderBy(*[F.col(c).desc() if desc else F.col(c).asc() for c, desc in sorts])
    return out if limit is None else out.limit(limit)


def top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest ``col``."""
    return df.orderBy(F.col(col).desc()).limit(n)


def joined_explore(
    results: DataFrame, invocations: DataFrame, fields: list[str], on: str = "invocation_id"
) -> DataFrame:
    """Run results left-joined with selected columns of their invocation."""
    clash = [f for f in fields if f in results.columns]
    if clash:
        raise ValueError(f"both sides have {clash}")
    return results.join(invocations.select(on, *fields), on, "left")


def enrich_run_results(
    results: DataFrame, nodes: DataFrame, fields: list[str], on: str = "unique_id"
) -> DataFrame:
    """Run results with metadata of the node (model, snapshot …) they ran."""
    return results.join(nodes.select(on, *fields), on)
