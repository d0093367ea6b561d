"""Sinks: full rebuilds, views, incremental appends and published tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmart.operators.intervals import newer_than_value, newest_mark


def _exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Create the table or replace it, as one step for its readers.

    Rows are written to a table beside the target, which takes the target's name when it is whole. A job
    may so read the table it replaces, and one that fails in the middle leaves the old rows.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:12]
    staged, old = f"{name}__new_{mark}", f"{name}__old_{mark}"
    try:
        df.write.format(fmt).saveAsTable(staged)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    if not _exists(spark, name):
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        return
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    except BaseException:
        spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    spark.sql(f"DROP TABLE {old}")


def write_view(df: DataFrame, name: str) -> None:
    """Register a lazy relation that consumers inline."""
    df.createOrReplaceTempView(name)


def verify_full_refresh(full_refresh: bool, allow_full_refresh: bool, prod: bool) -> None:
    """Refuse to rebuild a production table unless it is explicitly allowed."""
    if full_refresh and prod and not allow_full_refresh:
        raise ValueError("a full refresh in production needs allow_full_refresh=True")


def append_incremental(
    new: DataFrame,
    target: str,
    marks: list[str],
    merged_mark: str,
    full_refresh: bool = False,
    allow_full_refresh: bool = False,
    prod: bool = True,
    fmt: str = "parquet",
    keys: list[str] | None = None,
) -> DataFrame:
    """Append the rows newer than the target's newest mark; returns the target.

    A row is new when any timestamp in ``marks`` lies after ``max(merged_mark)``
    of the target. An absent or empty target takes all rows. With ``keys``, rows
    whose keys the target holds already are left out, so a job can be repeated
    after a failure. Without them a repeated run adds nothing only if no mark
    lies after the row's own ``merged_mark``. A full refresh may read the target. The newest mark is read
    first and becomes a value in the plan, so that the scan of the new rows skips what lies before it.
    """
    verify_full_refresh(full_refresh, allow_full_refresh, prod)
    spark = new.sparkSession
    if full_refresh or not _exists(spark, target):
        write_table(new, target, fmt)
        return spark.table(target)
    fresh = newer_than_value(new, marks, newest_mark(spark.table(target), merged_mark))
    if keys:
        held = spark.table(target).select(*[F.col(k).alias(f"__t_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, (fresh[k].eqNullSafe(held[f"__t_{k}"]) for k in keys))
        fresh = fresh.join(held, same, "left_anti")
    fresh.write.mode("append").format(fmt).saveAsTable(target)
    return spark.table(target)


@dataclass(frozen=True)
class Published:
    """What a consumer needs to find a published relation."""

    name: str
    comment: str
    kind: str


def target_schema(
    default_schema: str, custom_schema: str | None, sensitive: bool, prod: bool
) -> str:
    """Custom schemas count in production only; sensitive data gets its own schema."""
    base = custom_schema.strip() if prod and custom_schema is not None else default_schema
    return f"{base}_sensitive" if sensitive else base


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _comment(share_suffix: str | None, comment: str | None) -> str:
    if comment is not None:
        return comment
    return (share_suffix or "").replace("_", " ")


def publish_table(
    df: DataFrame,
    schema: str | None,
    name: str,
    comment: str | None = None,
    column_docs: dict[str, str] | None = None,
    sensitive: bool = False,
    prod: bool = False,
    share_suffix: str | None = None,
    default_schema: str = "default",
    fmt: str = "parquet",
) -> Published:
    """Build a table, keep its documentation with it, and describe it for consumers.

    ``share_suffix`` is required in production; with underscores as spaces it
    is the default comment.
    """
    if prod and share_suffix is None:
        raise ValueError("a production table needs share_suffix")
    unknown = set(column_docs or {}) - set(df.columns)
    if unknown:
        raise ValueError(f"documented columns do not exist: {sorted(unknown)}")
    spark = df.sparkSession
    target = target_schema(default_schema, schema, sensitive, prod)
    full_name = f"{target}.{name}"
    text = _comment(share_suffix, comment)
    for col, doc in (column_docs or {}).items():
        df = df.withMetadata(col, {**df.schema[col].metadata, "comment": doc})
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
    write_table(df, full_name, fmt)
    if text:
        spark.sql(f"COMMENT ON TABLE {full_name} IS {_quoted(text)}")
    return Published(full_name, text, "table")


def publish_view(
    spark: SparkSession,
    query: str | DataFrame,
    schema: str | None,
    name: str,
    comment: str | None = None,
    sensitive: bool = False,
    prod: bool = False,
    share_suffix: str | None = None,
    default_schema: str = "default",
    full_refresh: bool = False,
) -> Published:
    """Publish a query over tables as a view (a DataFrame becomes a session view).

    A table of the same name is an error, unless a full refresh may drop it.
    """
    if prod and share_suffix is None:
        raise ValueError("a production view needs share_suffix")
    text = _comment(share_suffix, comment)
    if isinstance(query, DataFrame):
        write_view(query, name)
        return Published(name, text, "session view")
    target = target_schema(default_schema, schema, sensitive, prod)
    full_name = f"{target}.{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
    if _exists(spark, full_name) and spark.catalog.getTable(full_name).tableType != "VIEW":
        if not full_refresh:
            raise ValueError(f"{full_name} is a table; pass full_refresh=True to replace it")
        spark.sql(f"DROP TABLE {full_name}")
    clause = f" COMMENT {_quoted(text)}" if text else ""
    spark.sql(f"CREATE OR REPLACE VIEW {full_name}{clause} AS {query}")
    return Published(full_name, text, "view")


def republish(
    spark: SparkSession, tables: dict[str, DataFrame], schema: str | None, **options
) -> list[Published]:
    """Publish unchanged copies of tables, named ``share_<table>``."""
    return [publish_table(df, schema, f"share_{name}", **options) for name, df in tables.items()]
