"""Platform usage, prices, discounts, memberships and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.functions.keys import composite_key, membership_id, row_id, surrogate_key
from spanmart.functions.predicates import equals_any
from spanmart.functions.text import map_lookup, safe_cast, struct_field

# The platform's own tag key → output column; owners add theirs.
USAGE_TAGS = {
    "job/dag_id": "tag_job_dag_id",
    "job/installation": "tag_job_installation",
    "job/environment": "tag_job_environment",
    "job/template": "tag_job_template",
    "job/ingestion_command": "tag_job_ingestion_command",
    "user:ResourceSource": "tag_aws_user_resource_source",
    "user:ResourceId": "tag_aws_user_resource_id",
    "user:ResourceType": "tag_aws_user_resource_type",
}
USAGE_METADATA = ("cluster_id", "job_id", "warehouse_id", "instance_pool_id", "node_type")
# The sources' columns.
USAGE_COLUMNS = (
    "record_id",
    "account_id",
    "workspace_id",
    "sku_name",
    "usage_start_time",
    "usage_end_time",
    "usage_date",
    "usage_quantity",
    "usage_unit",
    "cloud",
    "custom_tags",
    "usage_metadata",
)
TABLE_COLUMNS = (
    "table_catalog",
    "table_schema",
    "table_name",
    "table_type",
    "is_insertable_into",
    "commit_action",
    "table_owner",
    "comment",
    "created",
    "created_by",
    "last_altered",
    "last_altered_by",
    "data_source_format",
    "storage_sub_directory",
)
AUDIT_COLUMNS = (
    "account_id",
    "workspace_id",
    "version",
    "event_time",
    "event_date",
    "source_ip_address",
    "user_agent",
    "session_id",
    "user_identity",
    "service_name",
    "action_name",
    "request_id",
    "request_params",
    "response",
    "audit_level",
    "event_id",
)
DISCOUNT_SCHEMA = "id string, discount float, valid_from date, valid_to date"
WAREHOUSE_SCHEMA = "warehouse_id string, workspace_id string, warehouse_name string"
EVERYONE = "users"


def stage_usage(usage: DataFrame, workspaces: list) -> DataFrame:
    """Usage of the given workspaces, quantity as double."""
    kept = usage.filter(equals_any("workspace_id", workspaces)).select(*USAGE_COLUMNS)
    return kept.withColumn("usage_quantity", F.col("usage_quantity").cast("double"))


def usage_fact(usage: DataFrame, workspaces: list, tags: dict[str, str] | None = None) -> DataFrame:
    """Staged usage with its tags and compute metadata as columns.

    ``tags`` maps the owner's tag keys to output columns, beside the platform's.
    """
    return stage_usage(usage, workspaces).select(
        "*",
        *[map_lookup("custom_tags", tag).alias(name) for tag, name in {**USAGE_TAGS, **(tags or {})}.items()],
        *[
            struct_field("usage_metadata", field).alias(f"usage_metadata_{field}")
            for field in USAGE_METADATA
        ],
    )


def price_fact(list_prices: DataFrame) -> DataFrame:
    """List prices with a key over everything that identifies them."""
    return list_prices.select(
        surrogate_key(
            "account_id",
            "price_start_time",
            "price_end_time",
            "sku_name",
            "cloud",
            "currency_code",
            "pricing",
        ).alias("price_id"),
        "account_id",
        "price_start_time",
        "price_end_time",
        "sku_name",
        "cloud",
        "currency_code",
        "usage_unit",
        struct_field("pricing", "default").cast("double").alias("price"),
    )


def discount_fact(discounts: DataFrame) -> DataFrame:
    return discounts.select("id", "discount", "valid_from", "valid_to")


def warehouse_dim(warehouses: DataFrame) -> DataFrame:
    return warehouses.select("warehouse_id", "workspace_id", "warehouse_name")


def tables_dim(tables: DataFrame, system: bool = False) -> DataFrame:
    """Catalog listing with a dotted key; the system listing casts the type safely."""
    key = composite_key("table_catalog", "table_schema", "table_name")
    listed = tables.select(key.alias("information_schema_tables_id"), *TABLE_COLUMNS)
    if not system:
        return listed
    return listed.withColumn("table_type", safe_cast("table_type", "string"))


def share_usage_dim(shares: DataFrame) -> DataFrame:
    """Catalog, provider and share with a key built from the three columns."""
    key = F.concat("catalog_name", "provider_name", "share_name")
    return shares.select(
        key.alias("information_schema_catalog_provider_share_usage_id"),
        "catalog_name",
        "provider_name",
        "share_name",
    )


def audit_fact(audit: DataFrame) -> DataFrame:
    """Audit events with a row id. A full copy of a large table: run it on demand."""
    return audit.select(row_id().alias("system_access_audit_id"), *AUDIT_COLUMNS)


def group_dim(memberships: DataFrame) -> DataFrame:
    return memberships.select("group").distinct()


def user_dim(memberships: DataFrame) -> DataFrame:
    return memberships.select("user").distinct()


def group_user_bridge(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships, completed with a default group that holds every user."""
    everyone = users.select(
        F.col("user").alias("__user"), F.lit(EVERYONE).alias("__group")
    )
    joined = memberships.join(
        everyone,
        (memberships["group"] == everyone["__group"]) & (memberships["user"] == everyone["__user"]),
        "full",
    )
    completed = joined.select(
        F.coalesce("group", "__group").alias("group"),
        F.coalesce("__user", "user").alias("user"),
        "is_direct_group",
    )
    in_default = F.col("user").isNotNull() & (F.col("group") == EVERYONE)
    return completed.filter(in_default | (F.col("group") != EVERYONE)).select(
        "group",
        F.col("user").alias("user_name"),
        "is_direct_group",
        membership_id("group", "user", "is_direct_group").alias("group_user_id"),
    )
