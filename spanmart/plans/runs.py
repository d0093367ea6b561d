"""Job-run history: latest artifacts, invocations, rollups and run-time charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmart.functions.dates import duration_seconds, run_id_timestamp
from spanmart.functions.text import map_lookup, parse_json_map
from spanmart.operators.columns import star_except
from spanmart.operators.dedupe import keep_latest
from spanmart.operators.metrics import (
    DEFAULT_LIMIT,
    in_the_past,
    joined_explore,
    metric,
    metric_query,
    time_dimension,
)
from spanmart.sources.sinks import Published, republish

# Fixed values.
LATEST_ARTIFACTS = (
    "models",
    "tests",
    "sources",
    "seeds",
    "snapshots",
    "metrics",
    "exposures",
    "columns",
)
REPUBLISHED = (
    "dbt_artifacts_hashes",
    "dbt_run_results",
    "schema_columns_snapshot",
    "anomaly_threshold_sensitivity",
    "metrics_anomaly_score",
    "data_monitoring_metrics",
    "elementary_test_results",
    "model_run_results",
    "test_result_rows",
    "job_run_results",
    "snapshot_run_results",
    "dbt_source_freshness_results",
    "monitors_runs",
    "metadata",
    "alerts_anomaly_detection",
    "alerts_dbt_tests",
    "alerts_dbt_models",
    "alerts_dbt_source_freshness",
    "alerts_schema_changes",
)
RUN_ID_KEY = "AIRFLOW__DAG_RUN_ID"
RUN_FIELDS = ["run_started_at", "run_completed_at", "short_cosmos_invocation_id"]


def latest_artifacts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Newest row per ``unique_id`` of each artifact table."""
    unknown = set(tables) - set(LATEST_ARTIFACTS)
    if unknown:
        raise ValueError(f"not artifact tables: {sorted(unknown)}")
    return {name: keep_latest(df) for name, df in tables.items()}


def all_latest_artifacts(tables: dict[str, DataFrame]) -> DataFrame:
    """Newest row per artifact table and ``unique_id``, all tables in one pass.

    Columns are aligned by name and are NULL where a table lacks them; ``artifact`` names the table.
    """
    if not tables:
        raise ValueError("all_latest_artifacts needs at least one table")
    unknown = set(tables) - set(LATEST_ARTIFACTS)
    if unknown:
        raise ValueError(f"not artifact tables: {sorted(unknown)}")
    tagged = [tables[n].withColumn("artifact", F.lit(n)) for n in LATEST_ARTIFACTS if n in tables]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_latest(every, ["artifact", "unique_id"])


def republish_history(
    spark: SparkSession, tables: dict[str, DataFrame], schema: str | None, **options
) -> list[Published]:
    """Publish the run-history tables for consumers; all of ``REPUBLISHED`` are needed, in that order."""
    missing, unknown = set(REPUBLISHED) - set(tables), set(tables) - set(REPUBLISHED)
    if missing or unknown:
        raise ValueError(f"missing tables: {sorted(missing)}; not run history: {sorted(unknown)}")
    return republish(spark, {name: tables[name] for name in REPUBLISHED}, schema, **options)


def invocations(raw: DataFrame) -> DataFrame:
    """Invocations with their variables as a map, the run id and the run's timestamp."""
    others = star_except(raw, ["invocation_vars"]).columns
    kept = raw.select(*others, parse_json_map("invocation_vars").alias("invocation_vars"))
    run_id = map_lookup("invocation_vars", RUN_ID_KEY)
    return kept.select(
        "*",
        run_id.alias("cosmos_invocation_id"),
        run_id_timestamp(run_id).alias("short_cosmos_invocation_id"),
    )


def run_rollup(shared_invocations: DataFrame) -> DataFrame:
    """Start, end and duration per run timestamp."""
    runs = shared_invocations.groupBy("short_cosmos_invocation_id").agg(
        F.min(F.to_timestamp("run_started_at")).alias("run_started_at"),
        F.max(F.to_timestamp("run_completed_at")).alias("run_completed_at"),
    )
    seconds = duration_seconds("run_started_at", "run_completed_at")
    return runs.select(
        "*",
        seconds.alias("invocation_duration_seconds"),
        (seconds / 60).alias("invocation_duration_minutes"),
    )


def runtime_history(
    rollup: DataFrame, now: Column | None = None, days: int = 7, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Total run minutes per hour over the last days, newest first."""
    stamp = "short_cosmos_invocation_id"
    return metric_query(
        rollup,
        [time_dimension(stamp, "HOUR")],
        [metric("sum_invocation_duration_minutes", "sum", "invocation_duration_minutes")],
        filters=[in_the_past(stamp, days, now, grain="DAY")],
        sorts=[(f"{stamp}_hour", True)],
        limit=limit,
    )


def node_runtime_history(
    results: DataFrame,
    shared_invocations: DataFrame,
    unique_id: str,
    now: Column | None = None,
    days: int = 7,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Minutes one node ran per hour over the last days, newest first."""
    stamp = "short_cosmos_invocation_id"
    explore = joined_explore(
        results.filter(F.col("unique_id") == unique_id), shared_invocations, RUN_FIELDS
    )
    return metric_query(
        explore,
        [time_dimension(stamp, "HOUR")],
        [metric("sum_node_execution_time_minutes", "sum", "execution_time / 60")],
        filters=[in_the_past(stamp, days, now)],
        sorts=[(f"{stamp}_hour", True)],
        limit=limit,
    )
