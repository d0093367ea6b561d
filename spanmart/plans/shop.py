"""Shop star schema: staging and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.functions.keys import flag, label, surrogate_key
from spanmart.functions.text import cents_to_dollars
from spanmart.operators.columns import rename_columns
from spanmart.operators.ordinals import WINDOW_ROWS, running_ordinal
from spanmart.sources.sinks import write_table


def stage_customers(raw: DataFrame) -> DataFrame:
    return rename_columns(raw, {"id": "customer_id", "name": "customer_name"})


def stage_locations(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("location_id"),
        F.col("name").alias("location_name"),
        "tax_rate",
        F.col("opened_at").cast("date").alias("opened_date"),
    )


def stage_order_items(raw: DataFrame) -> DataFrame:
    return rename_columns(
        raw, {"id": "order_item_id", "order_id": "order_id", "sku": "product_id"}
    )


def stage_orders(raw: DataFrame) -> DataFrame:
    money = ["subtotal", "tax_paid", "order_total"]
    return raw.select(
        F.col("id").alias("order_id"),
        F.col("store_id").alias("location_id"),
        F.col("customer").alias("customer_id"),
        *[F.col(c).alias(f"{c}_cents") for c in money],
        *[cents_to_dollars(c).alias(c) for c in money],
        F.col("ordered_at").cast("date").alias("order_date"),
    )


def stage_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("sku").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("type").alias("product_type"),
        F.col("description").alias("product_description"),
        cents_to_dollars("price").alias("product_price"),
        flag(F.col("type") == "jaffle").alias("is_food_item"),
        flag(F.col("type") == "beverage").alias("is_drink_item"),
    )


def stage_supplies(raw: DataFrame) -> DataFrame:
    return raw.select(
        surrogate_key("id", "sku").alias("supply_uuid"),
        F.col("id").alias("supply_id"),
        F.col("sku").alias("product_id"),
        F.col("name").alias("supply_name"),
        cents_to_dollars("cost").alias("supply_cost"),
        F.col("perishable").alias("is_perishable_supply"),
    )


def mart_order_items(
    order_items: DataFrame, orders: DataFrame, products: DataFrame, supplies: DataFrame
) -> DataFrame:
    """Items with order date, product and total supply cost of the product.

    Products and supply costs share a key, so they are joined with each other
    first. The items then meet them in one join, which AQE can split when one
    product holds a large share of the items.
    """
    costs = supplies.groupBy("product_id").agg(F.sum("supply_cost").alias("supply_cost"))
    product_facts = products.select(
        "product_id", "product_name", "product_price", "is_food_item", "is_drink_item"
    ).join(costs, "product_id", "full")
    dates = orders.select("order_id", "order_date")
    joined = order_items.join(dates, "order_id", "left").join(product_facts, "product_id", "left")
    return joined.select(
        *order_items.columns,
        "order_date",
        "product_name",
        "product_price",
        "is_food_item",
        "is_drink_item",
        "supply_cost",
    )


def _count_if(col: str):
    return F.sum(F.when(F.col(col), F.lit(1)).otherwise(F.lit(0)))


def mart_orders(
    orders: DataFrame, order_items: DataFrame, hot_rows: int | None = WINDOW_ROWS
) -> DataFrame:
    """Orders with item totals, food and drink flags and the customer's running order number."""
    summary = order_items.groupBy("order_id").agg(
        F.sum("supply_cost").alias("order_cost"),
        F.sum("product_price").alias("order_items_subtotal"),
        _count_if("is_food_item").alias("count_food_items"),
        _count_if("is_drink_item").alias("count_drink_items"),
        F.count("order_item_id").alias("count_order_items"),
    )
    # Numbered before the join: the number needs order columns only.
    numbered = running_ordinal(
        orders, ["customer_id"], ["order_date", "order_id"], "customer_order_number", hot_rows
    )
    joined = numbered.join(summary, "order_id", "left")
    return joined.select(
        *orders.columns,
        "order_cost",
        "order_items_subtotal",
        "count_food_items",
        "count_drink_items",
        "count_order_items",
        (F.col("count_food_items") > 0).alias("is_food_order"),
        (F.col("count_drink_items") > 0).alias("is_drink_order"),
        "customer_order_number",
    )


def mart_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with lifetime totals and a new/returning label."""
    summary = orders.groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("count_lifetime_orders"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.sum("subtotal").alias("lifetime_spend_pretax"),
        F.sum("tax_paid").alias("lifetime_tax_paid"),
        F.sum("order_total").alias("lifetime_spend"),
    )
    joined = customers.join(summary, "customer_id", "left")
    return joined.select(
        *customers.columns,
        "count_lifetime_orders",
        "first_order_date",
        "last_order_date",
        "lifetime_spend_pretax",
        "lifetime_tax_paid",
        "lifetime_spend",
        label(F.col("count_lifetime_orders") > 1, "returning", "new").alias("customer_type"),
    )


def mart_locations(locations: DataFrame) -> DataFrame:
    return locations


def mart_products(products: DataFrame) -> DataFrame:
    return products


def mart_supplies(supplies: DataFrame) -> DataFrame:
    return supplies


def build_marts(raw: dict[str, DataFrame], schema: str) -> dict[str, DataFrame]:
    """Stage the raw tables and write all six marts to ``schema``; returns the marts.

    ``raw`` has customers, stores, items, orders, products and supplies.
    """
    customers, locations = stage_customers(raw["customers"]), stage_locations(raw["stores"])
    orders, items = stage_orders(raw["orders"]), stage_order_items(raw["items"])
    products, supplies = stage_products(raw["products"]), stage_supplies(raw["supplies"])
    spark = orders.sparkSession
    out = {}

    def build(name: str, df: DataFrame) -> None:
        write_table(df, f"{schema}.{name}")
        out[name] = spark.table(f"{schema}.{name}")

    build("order_items", mart_order_items(items, orders, products, supplies))
    build("orders", mart_orders(orders, out["order_items"]))
    build("customers", mart_customers(customers, out["orders"]))
    build("locations", mart_locations(locations))
    build("products", mart_products(products))
    build("supplies", mart_supplies(supplies))
    return out
