"""Date, time and time-zone expressions.

Every function returns a lazy Column (or DataFrame for the spines). Timestamps
are UTC instants; the session zone must be UTC (see ``spanmart.session``).
Local wall time is derived last, because two UTC instants share one wall time
when clocks go back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FAR_FUTURE = "2099-12-31 23:59:59"
DATE_TABLE_END = "2099-01-01"
MS_MIDNIGHT = -1462009856
REGIONAL_ZONES = {
    "london": "Europe/London",
    "paris": "Europe/Paris",
    "berlin": "Europe/Berlin",
    "tokyo": "Asia/Tokyo",
    "wellington": "Pacific/Auckland",
    "texas": "America/Chicago",
    "madrid": "Europe/Madrid",
}

SPINE_PARTS = ("second", "minute", "hour", "day", "week", "month", "year")
_SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}
_MONTHS = {"month": 1, "year": 12}


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def current_timestamp_utc() -> Column:
    return F.current_timestamp()


def localize(ts: Column | str, tz: str = "UTC") -> Column:
    """Wall time in ``tz`` of a UTC timestamp."""
    return F.from_utc_timestamp(as_col(ts), tz)


def current_timestamp_local(tz: str = "UTC") -> Column:
    return localize(current_timestamp_utc(), tz)


def current_date_local(tz: str = "UTC") -> Column:
    return F.to_date(current_timestamp_local(tz))


def to_local_date(ts: Column | str, localized: bool = True, tz: str = "UTC") -> Column:
    """Date of a timestamp, in ``tz`` unless ``localized`` is False."""
    return F.to_date(localize(ts, tz) if localized else as_col(ts))


def local_midnight_timestamp(ts: Column | str, tz: str = "UTC") -> Column:
    """UTC instant at which the local day of ``ts`` begins."""
    return F.to_utc_timestamp(to_local_date(ts, tz=tz), tz)


def timestamp_to_utc(ts: Column | str) -> Column:
    """Mark a zone-less timestamp that holds UTC wall time as a UTC instant."""
    return F.to_utc_timestamp(as_col(ts), "UTC")


def to_report_date(date: Column | str, tz: str = "UTC", now: Column | None = None) -> Column:
    """Month end for past months; today for the current month and later.

    ``now`` is a UTC timestamp, injectable so that reports can be reproduced.
    """
    date = as_col(date)
    local_now = localize(current_timestamp_utc() if now is None else now, tz)
    previous_month_end = F.last_day(F.add_months(F.to_date(local_now), -1))
    return F.when(date > previous_month_end, F.to_date(local_now)).otherwise(F.last_day(date))


def regional_timezones(df: DataFrame, col: str, zones: dict[str, str] | None = None) -> DataFrame:
    """Add ``<col>_<city>_tz`` with the wall time of each region."""
    added = {
        f"{col}_{city}_tz": localize(col, tz) for city, tz in (zones or REGIONAL_ZONES).items()
    }
    return df.withColumns(added)


def _spine(spark: SparkSession, name: str, part: str, start: str, end: str, step: int) -> DataFrame:
    if part.lower() not in SPINE_PARTS:
        raise ValueError(f"date part must be one of {SPINE_PARTS}, got {part!r}")
    if step < 1:
        raise ValueError("granularity must be at least 1")
    # One row per step, made where it is needed: no array of all steps in one task.
    first, last = (F.lit(x).cast("timestamp") for x in (start, end))
    begun, ended = (datetime.fromisoformat(x) for x in (start, end))
    if part.lower() in _MONTHS:
        months = _MONTHS[part.lower()] * step
        n = ((ended.year - begun.year) * 12 + ended.month - begun.month) // months + 1
        value = F.timestamp_add("MONTH", (F.col("id") * months).cast("int"), first)
    else:
        width = _SECONDS[part.lower()] * step
        n = int((ended - begun).total_seconds() // width) + 1
        value = F.timestamp_micros(F.unix_micros(first) + F.col("id") * (width * 1_000_000))
    return spark.range(max(n, 0)).select(value.alias(name)).where(F.col(name) <= last)


def date_spine(
    spark: SparkSession, part: str, start: str, end: str, granularity: int = 1
) -> DataFrame:
    """One row per step from ``start`` to ``end``, both included, as ``date_<part>``."""
    return _spine(spark, f"date_{part.lower()}", part.lower(), start, end, granularity)


def build_date_spine(spark: SparkSession, start: str, end: str = DATE_TABLE_END) -> DataFrame:
    """Day table from ``start`` up to but excluding ``end``."""
    days = _spine(spark, "date_day", "day", start, end, 1)
    weekday = F.date_format("date_day", "E")
    return days.filter(F.col("date_day") < F.lit(end).cast("timestamp")).select(
        F.to_date("date_day").alias("date_day"),
        weekday.alias("day_of_week"),
        weekday.isin("Sat", "Sun").alias("is_weekend"),
    )


def ms_int_to_time(
    col: Column | str, reference_ms: int = MS_MIDNIGHT, fmt: str = "HH:mm:ss"
) -> Column:
    """Milliseconds after a reference midnight → time of day as an interval."""
    instant = F.timestamp_millis(as_col(col).cast("long") - F.lit(reference_ms))
    return F.date_format(instant, fmt).cast("interval hour to second")


def split_str_time_range(
    col: Column | str, start_period: bool = True, far_future: str = FAR_FUTURE
) -> Column:
    """Start or end of a range written as text, such as ``["t1","t2")``.

    A missing end is open and becomes the far future.
    """
    side = F.get(F.split(as_col(col), ","), F.lit(0 if start_period else 1))
    quoted = F.get(F.split(side, '"'), F.lit(1))
    if start_period:
        return quoted.cast("timestamp")
    return F.coalesce(quoted.cast("timestamp"), F.lit(far_future).cast("timestamp"))


def run_id_timestamp(col: Column | str) -> Column:
    """``trigger__<timestamp>`` → the timestamp; NULL when there is none."""
    return F.try_to_timestamp(F.get(F.split(as_col(col), "__"), F.lit(1)))


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    return F.unix_timestamp(as_col(end)) - F.unix_timestamp(as_col(start))
