"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for results (zone, ANSI) or for skew at run time (AQE).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Shuffled bytes per partition that an executor core handles without spilling much.
PARTITION_BYTES = 128 << 20


def partitions_for(shuffle_bytes: int) -> int:
    """Shuffle partitions for the largest shuffle expected.

    AQE merges small partitions but never splits one beyond the starting
    number (skewed joins apart), so large jobs must start high.
    """
    return max(200, -(-shuffle_bytes // PARTITION_BYTES))


def build_session(
    app: str = "spanmart",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    ``shuffle_bytes`` sizes shuffles for the largest one expected.
    """
    if shuffle_bytes is not None:
        conf["spark.sql.shuffle.partitions"] = str(partitions_for(shuffle_bytes))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Apply the same settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark
