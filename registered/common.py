"""Loading tables and deriving the interval tables the queries use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmart.session import apply_settings
from spanmart.sources.readers import read_table

FAR = "TIMESTAMP '2099-12-31 23:59:59'"


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry(dict):
    def query(self, sql: str | None):
        """Register the decorated function under its own name."""

        def add(fn):
            self[fn.__name__] = Registered(fn, sql)
            return fn

        return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(apply_settings(spark), sf_dir, name)


def days(col: Column) -> Column:
    return F.make_dt_interval(col.cast("int"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as periods per customer: 1 to 400 days, every fiftieth one open."""
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ends = F.when(key % 50 != 0, F.col("o_orderdate") + days(key % 400 + 1))
    return orders.select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_orderdate").alias("valid_from"),
        ends.alias("valid_to"),
    )


PERIODS_SQL = """periods AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderdate AS valid_from,
         CASE WHEN o_orderkey % 50 <> 0
              THEN o_orderdate + to_days(CAST(o_orderkey % 400 + 1 AS INTEGER)) END AS valid_to
  FROM orders)"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as periods per customer, as long as the quantity in days."""
    items = load(spark, sf_dir, "lineitem")
    # Two columns of a large file look small enough to be broadcast, all their rows are not.
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        "o_custkey",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shipment"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("o_orderstatus"),
        F.col("l_shipdate").alias("ship_from"),
        (F.col("l_shipdate") + days(F.col("l_quantity"))).alias("ship_to"),
    )


SHIPMENTS_SQL = """shipments AS (
  SELECT o_custkey, l_orderkey * 10 + l_linenumber AS shipment, l_partkey AS part, l_returnflag AS o_orderstatus,
         l_shipdate AS ship_from,
         l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS ship_to
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sequence_sql(
    name: str, source: str, key: str, start: str, end: str, order: str, values: list[str]
) -> str:
    """CTEs that break ``source`` into pieces: ``<name>`` has key, a, b, values, n."""
    picked = ", ".join(f"max_by(t.{v}, ({order})) AS {v}" for v in values)
    return f"""{name}_points AS (
  SELECT DISTINCT {key}, unnest([{start}, {end}]) AS p FROM {source}
  WHERE {key} IS NOT NULL AND {start} < coalesce({end}, {FAR})),
{name}_pieces AS (
  SELECT {key}, p AS a, lead(p) OVER (PARTITION BY {key} ORDER BY p ASC NULLS LAST) AS b,
         row_number() OVER (PARTITION BY {key} ORDER BY p DESC NULLS FIRST) AS from_last
  FROM {name}_points),
{name} AS (
  SELECT i.{key}, i.a, i.b, {picked + ", " if picked else ""}count(*) AS n
  FROM {name}_pieces i JOIN {source} t ON t.{key} = i.{key}
   AND greatest(t.{start}, i.a) < least(coalesce(t.{end}, {FAR}), coalesce(i.b, {FAR}))
  WHERE i.from_last <> 1 AND t.{start} < coalesce(t.{end}, {FAR})
  GROUP BY i.{key}, i.a, i.b)"""
