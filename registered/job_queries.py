"""Complete jobs: shop marts, platform usage, memberships and run history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registered.common import Registry, load
from spanmart.operators.dedupe import keep_latest
from spanmart.operators.metrics import enrich_run_results, metric, metric_query, time_dimension, top_n
from spanmart.operators.quality import contract_failures
from spanmart.plans import runs, shop, usage

QUERIES = Registry()


def _date(col):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def _doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ------------------------------------------------------------ shop


def _raw_orders(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    tax = F.floor(cents / 20).cast("long")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("store_id"),
        F.col("o_custkey").alias("customer"),
        cents.alias("subtotal"),
        tax.alias("tax_paid"),
        (cents + tax).alias("order_total"),
        F.col("o_orderdate").alias("ordered_at"),
    )


def _raw_items(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku"),
    )


def _raw_products(spark, sf_dir):
    size = F.col("p_size")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku"),
        F.col("p_name").alias("name"),
        F.when(size > 30, F.lit("jaffle")).when(size > 10, F.lit("beverage")).alias("type"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("price"),
        F.col("p_brand").alias("description"),
    )


def _raw_supplies(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"),
        F.concat(F.lit("supply "), F.col("l_suppkey")).alias("name"),
        F.round(F.col("l_extendedprice")).cast("long").alias("cost"),
        (F.col("l_returnflag") == "R").alias("perishable"),
        F.col("l_partkey").alias("sku"),
    )


_MONEY = "CAST(CAST({0} AS DECIMAL(18, 2)) / 100 AS DECIMAL(16, 2))"
_SHOP = f"""WITH cents AS (
  SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
orders_s AS (
  SELECT o_orderkey AS order_id, o_orderpriority AS location_id, o_custkey AS customer_id,
         c AS subtotal_cents, c // 20 AS tax_paid_cents, c + c // 20 AS order_total_cents,
         {_MONEY.format('c')} AS subtotal, {_MONEY.format('c // 20')} AS tax_paid,
         {_MONEY.format('(c + c // 20)')} AS order_total,
         strftime(o_orderdate, '%Y-%m-%d') AS order_date
  FROM cents),
items_s AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
         l_partkey AS product_id FROM lineitem),
products_s AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CASE WHEN p_size > 30 THEN 'jaffle' WHEN p_size > 10 THEN 'beverage' END AS product_type,
         p_brand AS product_description,
         {_MONEY.format('CAST(round(p_retailprice * 100) AS BIGINT)')} AS product_price,
         p_size > 30 AS is_food_item, p_size > 10 AND p_size <= 30 AS is_drink_item
  FROM part),
supplies_s AS (
  SELECT md5(CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)) AS supply_uuid,
         l_suppkey AS supply_id, l_partkey AS product_id,
         'supply ' || CAST(l_suppkey AS VARCHAR) AS supply_name,
         {_MONEY.format('CAST(round(l_extendedprice) AS BIGINT)')} AS supply_cost,
         l_returnflag = 'R' AS is_perishable_supply
  FROM lineitem),
costs AS (SELECT product_id, sum(supply_cost) AS supply_cost FROM supplies_s GROUP BY 1),
order_items AS (
  SELECT i.*, o.order_date, p.product_name, p.product_price, p.is_food_item, p.is_drink_item,
         c.supply_cost
  FROM items_s i LEFT JOIN orders_s o ON i.order_id = o.order_id
  LEFT JOIN products_s p ON i.product_id = p.product_id
  LEFT JOIN costs c ON i.product_id = c.product_id),
item_summary AS (
  SELECT order_id, sum(supply_cost) AS order_cost, sum(product_price) AS order_items_subtotal,
         count(CASE WHEN is_food_item THEN 1 END) AS count_food_items,
         count(CASE WHEN is_drink_item THEN 1 END) AS count_drink_items,
         count(order_item_id) AS count_order_items
  FROM order_items GROUP BY 1)
"""
_ORDER_MONEY = ("subtotal", "tax_paid", "order_total")
_ORDER_COLUMNS = """o.order_id, location_id, customer_id, subtotal_cents, tax_paid_cents,
 order_total_cents, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_paid AS DOUBLE) AS tax_paid,
 CAST(order_total AS DOUBLE) AS order_total, order_date"""


@QUERIES.query(f"{_SHOP} SELECT {_ORDER_COLUMNS} FROM orders_s o")
def stage_orders(spark, sf_dir):
    staged = shop.stage_orders(_raw_orders(spark, sf_dir))
    return _doubles(staged, *_ORDER_MONEY).withColumn("order_date", _date("order_date"))


@QUERIES.query(f"{_SHOP} SELECT * FROM items_s")
def stage_order_items(spark, sf_dir):
    return shop.stage_order_items(_raw_items(spark, sf_dir))


@QUERIES.query(f"""{_SHOP} SELECT * REPLACE (CAST(product_price AS DOUBLE) AS product_price)
FROM products_s""")
def stage_products(spark, sf_dir):
    return _doubles(shop.stage_products(_raw_products(spark, sf_dir)), "product_price")


@QUERIES.query(f"{_SHOP} SELECT * REPLACE (CAST(supply_cost AS DOUBLE) AS supply_cost) FROM supplies_s")
def stage_supplies(spark, sf_dir):
    return _doubles(shop.stage_supplies(_raw_supplies(spark, sf_dir)), "supply_cost")


@QUERIES.query("SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer")
def stage_customers(spark, sf_dir):
    raw = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ID"), F.col("c_name").alias("NAME")
    )
    return shop.stage_customers(raw)


@QUERIES.query("""SELECT s_suppkey AS location_id, s_name AS location_name,
 s_acctbal / 1000 AS tax_rate, strftime(opened, '%Y-%m-%d') AS opened_date
FROM supplier JOIN (SELECT l_suppkey, min(l_shipdate) + INTERVAL 13 HOUR AS opened
                    FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def stage_locations(spark, sf_dir):
    """Suppliers as stores, opened with their first shipment."""
    first = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        (F.min("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(13))).alias("opened_at")
    )
    raw = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        (F.col("s_acctbal") / 1000).alias("tax_rate"),
    )
    staged = shop.mart_locations(shop.stage_locations(raw.join(first, "id")))
    return staged.withColumn("opened_date", _date("opened_date"))


def _order_items(spark, sf_dir):
    return shop.mart_order_items(
        shop.stage_order_items(_raw_items(spark, sf_dir)),
        shop.stage_orders(_raw_orders(spark, sf_dir)),
        shop.stage_products(_raw_products(spark, sf_dir)),
        shop.stage_supplies(_raw_supplies(spark, sf_dir)),
    )


@QUERIES.query(f"""{_SHOP} SELECT * REPLACE (CAST(product_price AS DOUBLE) AS product_price,
 CAST(supply_cost AS DOUBLE) AS supply_cost) FROM order_items""")
def mart_order_items(spark, sf_dir):
    items = _order_items(spark, sf_dir).withColumn("order_date", _date("order_date"))
    return _doubles(items, "product_price", "supply_cost")


@QUERIES.query(f"""{_SHOP} SELECT {_ORDER_COLUMNS}, CAST(order_cost AS DOUBLE) AS order_cost,
 CAST(order_items_subtotal AS DOUBLE) AS order_items_subtotal, count_food_items,
 count_drink_items, count_order_items,
 CAST(count_food_items > 0 AS VARCHAR) AS is_food_order,
 CAST(count_drink_items > 0 AS VARCHAR) AS is_drink_order,
 row_number() OVER (PARTITION BY customer_id ORDER BY order_date, o.order_id)
   AS customer_order_number
FROM orders_s o LEFT JOIN item_summary s ON o.order_id = s.order_id""")
def mart_orders(spark, sf_dir):
    orders = shop.mart_orders(
        shop.stage_orders(_raw_orders(spark, sf_dir)), _order_items(spark, sf_dir)
    ).withColumn("order_date", _date("order_date"))
    # Flags of orders without items are NULL; as text they compare alike everywhere.
    orders = orders.withColumns(
        {c: F.col(c).cast("string") for c in ("is_food_order", "is_drink_order")}
    )
    return _doubles(orders, *_ORDER_MONEY, "order_cost", "order_items_subtotal")


@QUERIES.query(f"""{_SHOP}, lifetime AS (
  SELECT customer_id, count(DISTINCT order_id) AS n, min(order_date) AS first_order_date,
         max(order_date) AS last_order_date, sum(subtotal) AS s, sum(tax_paid) AS t,
         sum(order_total) AS o FROM orders_s GROUP BY 1)
SELECT c_custkey AS customer_id, c_name AS customer_name, n AS count_lifetime_orders,
 first_order_date, last_order_date, CAST(s AS DOUBLE) AS lifetime_spend_pretax,
 CAST(t AS DOUBLE) AS lifetime_tax_paid, CAST(o AS DOUBLE) AS lifetime_spend,
 CASE WHEN n > 1 THEN 'returning' ELSE 'new' END AS customer_type
FROM customer LEFT JOIN lifetime ON c_custkey = customer_id""")
def mart_customers(spark, sf_dir):
    customers = shop.mart_customers(
        stage_customers(spark, sf_dir), shop.stage_orders(_raw_orders(spark, sf_dir))
    )
    dated = customers.withColumns(
        {c: _date(c) for c in ("first_order_date", "last_order_date")}
    )
    return _doubles(dated, "lifetime_spend_pretax", "lifetime_tax_paid", "lifetime_spend")


# ------------------------------------------------------------ platform usage


def _raw_usage(spark, sf_dir):
    """Events as usage records; the event type plays the workspace."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("user_id").cast("string").alias("account_id"),
        kind.alias("workspace_id"),
        F.concat(F.lit("sku-"), k).alias("sku_name"),
        F.col("ts").alias("usage_start_time"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("usage_end_time"),
        F.to_date("ts").alias("usage_date"),
        F.col("value").cast("decimal(20,4)").alias("usage_quantity"),
        F.lit("DBU").alias("usage_unit"),
        F.lit("AWS").alias("cloud"),
        F.when(kind == "view", F.create_map(F.lit("job/dag_id"), k))
        .otherwise(F.create_map(F.lit("org:product"), kind, F.lit("job/dag_id"), kind))
        .alias("custom_tags"),
        F.struct(
            k.alias("cluster_id"),
            F.when(kind == "click", k).alias("job_id"),
            F.lit("w1").alias("warehouse_id"),
            F.lit(None).cast("string").alias("instance_pool_id"),
            kind.alias("node_type"),
        ).alias("usage_metadata"),
    )


# A tag of the owner, beside the platform's.
OWN_TAGS = {"org:product": "tag_org_product"}
_EMPTY_TAGS = ", ".join(
    f"CAST(NULL AS VARCHAR) AS {name}"
    for name in usage.USAGE_TAGS.values()
    if name not in ("tag_job_dag_id", "tag_org_product")
)


@QUERIES.query(f"""SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS account_id,
 event_type AS workspace_id, 'sku-' || json_extract_string(props, '$.k') AS sku_name,
 ts AS usage_start_time, ts + INTERVAL 1 HOUR AS usage_end_time,
 strftime(ts, '%Y-%m-%d') AS usage_date,
 CAST(CAST(value AS DECIMAL(20, 4)) AS DOUBLE) AS usage_quantity, 'DBU' AS usage_unit, 'AWS' AS cloud,
 CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') ELSE event_type END
   AS tag_job_dag_id,
 CASE WHEN event_type <> 'view' THEN event_type END AS tag_org_product, {_EMPTY_TAGS},
 json_extract_string(props, '$.k') AS usage_metadata_cluster_id,
 CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END
   AS usage_metadata_job_id,
 'w1' AS usage_metadata_warehouse_id, CAST(NULL AS VARCHAR) AS usage_metadata_instance_pool_id,
 event_type AS usage_metadata_node_type
FROM events WHERE event_type = 'view' OR event_type = 'click'""")
def usage_fact(spark, sf_dir):
    fact = usage.usage_fact(_raw_usage(spark, sf_dir), ["view", "click"], OWN_TAGS)
    return fact.drop("custom_tags", "usage_metadata").withColumn("usage_date", _date("usage_date"))


_NO_KEY = "'_dbt_utils_surrogate_key_null_'"


@QUERIES.query(f"""WITH prices AS (
  SELECT p_brand AS account_id, TIMESTAMP '2020-01-01' + to_days(p_size) AS price_start_time,
         CASE WHEN p_type <> 'ECONOMY' THEN TIMESTAMP '2021-01-01' + to_days(p_size) END
           AS price_end_time,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) AS sku_name, p_type AS cloud,
         'GBP' AS currency_code, 'DBU' AS usage_unit,
         CAST(p_retailprice AS DECIMAL(12, 2)) AS amount FROM part)
SELECT md5(account_id || '-' || CAST(price_start_time AS VARCHAR) || '-'
  || coalesce(CAST(price_end_time AS VARCHAR), {_NO_KEY}) || '-' || sku_name || '-' || cloud
  || '-' || currency_code || '-{{' || CAST(amount AS VARCHAR) || '}}') AS price_id,
  account_id, price_start_time, price_end_time, sku_name, cloud, currency_code, usage_unit,
  CAST(amount AS DOUBLE) AS price FROM prices""")
def price_fact(spark, sf_dir):
    def after(year):
        return F.lit(f"{year}-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))

    prices = load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("account_id"),
        after(2020).alias("price_start_time"),
        F.when(F.col("p_type") != "ECONOMY", after(2021)).alias("price_end_time"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("sku_name"),
        F.col("p_type").alias("cloud"),
        F.lit("GBP").alias("currency_code"),
        F.lit("DBU").alias("usage_unit"),
        F.struct(F.col("p_retailprice").cast("decimal(12,2)").alias("default")).alias("pricing"),
    )
    return usage.price_fact(prices)


@QUERIES.query("""SELECT s_name AS id, CAST(CAST(s_acctbal / 10000 AS FLOAT) AS DOUBLE) AS discount,
 strftime(first_ship, '%Y-%m-%d') AS valid_from, '9999-12-31' AS valid_to
FROM supplier JOIN (SELECT l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1)
 ON l_suppkey = s_suppkey""")
def discount_fact(spark, sf_dir):
    first = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_shipdate").cast("date").alias("valid_from")
    )
    suppliers = load(spark, sf_dir, "supplier")
    discounts = suppliers.join(first, suppliers.s_suppkey == first.l_suppkey).select(
        F.col("s_name").alias("id"),
        (F.col("s_acctbal") / 10000).cast("float").alias("discount"),
        "valid_from",
        F.lit("9999-12-31").cast("date").alias("valid_to"),
    )
    dated = _doubles(usage.discount_fact(discounts), "discount")
    return dated.withColumns({c: _date(c) for c in ("valid_from", "valid_to")})


@QUERIES.query("""SELECT CAST(s_suppkey AS VARCHAR) AS warehouse_id, n_name AS workspace_id,
 s_name AS warehouse_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def warehouse_dim(spark, sf_dir):
    suppliers, nations = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    joined = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    return usage.warehouse_dim(
        joined.select(
            F.col("s_suppkey").cast("string").alias("warehouse_id"),
            F.col("n_name").alias("workspace_id"),
            F.col("s_name").alias("warehouse_name"),
        )
    )


def _listing(spark, sf_dir):
    known = {
        "table_catalog": F.col("p_type"),
        "table_schema": F.col("p_brand"),
        "table_name": F.concat_ws("_", "p_name", "p_partkey"),
        "table_type": F.when(F.col("p_size") > 20, F.lit("MANAGED")).otherwise(F.lit("VIEW")),
    }
    return load(spark, sf_dir, "part").select(
        *[
            known.get(c, F.lit(None).cast("string")).alias(c)
            for c in usage.TABLE_COLUMNS
        ]
    )


_LISTING = """SELECT p_type || '.' || p_brand || '.' || p_name || '_' || CAST(p_partkey AS VARCHAR)
   AS information_schema_tables_id, p_type AS table_catalog, p_brand AS table_schema,
 p_name || '_' || CAST(p_partkey AS VARCHAR) AS table_name,
 CASE WHEN p_size > 20 THEN 'MANAGED' ELSE 'VIEW' END AS table_type FROM part"""
_LISTED = ["information_schema_tables_id", "table_catalog", "table_schema", "table_name", "table_type"]


@QUERIES.query(_LISTING)
def tables_dim(spark, sf_dir):
    return usage.tables_dim(_listing(spark, sf_dir)).select(*_LISTED)


@QUERIES.query(_LISTING)
def tables_dim_system(spark, sf_dir):
    return usage.tables_dim(_listing(spark, sf_dir), system=True).select(*_LISTED)


@QUERIES.query("""SELECT r_name || n_name || s_name AS information_schema_catalog_provider_share_usage_id,
 r_name AS catalog_name, n_name AS provider_name, s_name AS share_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def share_usage_dim(spark, sf_dir):
    suppliers, nations = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    regions = load(spark, sf_dir, "region")
    shares = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).join(
        regions, nations.n_regionkey == regions.r_regionkey
    )
    return usage.share_usage_dim(
        shares.select(
            F.col("r_name").alias("catalog_name"),
            F.col("n_name").alias("provider_name"),
            F.col("s_name").alias("share_name"),
        )
    )


@QUERIES.query("""SELECT event_id, CAST(user_id AS VARCHAR) AS user_identity, ts AS event_time,
 event_type AS action_name, count(*) OVER () AS distinct_ids FROM events""")
def audit_fact(spark, sf_dir):
    """Audit rows; the row id differs between runs, so its distinct count is shown."""
    known = {
        "event_id": F.col("event_id"),
        "user_identity": F.col("user_id").cast("string"),
        "event_time": F.col("ts"),
        "action_name": F.col("event_type"),
    }
    audit = load(spark, sf_dir, "events").select(
        *[known.get(c, F.lit(None).cast("string")).alias(c) for c in usage.AUDIT_COLUMNS]
    )
    fact = usage.audit_fact(audit)
    ids = fact.agg(F.countDistinct("system_access_audit_id")).scalar()
    return fact.select(*known, ids.alias("distinct_ids"))


def _memberships(spark, sf_dir):
    """Users by the kinds of events they made; signing up is the default group."""
    events = load(spark, sf_dir, "events")
    group = F.when(F.col("event_type") == "signup", F.lit("users")).otherwise(F.col("event_type"))
    return events.groupBy(F.col("user_id").cast("string").alias("user"), group.alias("group")).agg(
        F.when(F.max("event_id") > 100, F.max("value") > 20).alias("is_direct_group")
    )


_MEMBERS = """members AS (
  SELECT CAST(user_id AS VARCHAR) AS u,
         CASE WHEN event_type = 'signup' THEN 'users' ELSE event_type END AS g,
         CASE WHEN max(event_id) > 100 THEN max(value) > 20 END AS d
  FROM events GROUP BY 1, 2)"""


@QUERIES.query(f"WITH {_MEMBERS} SELECT DISTINCT g AS \"group\" FROM members")
def group_dim(spark, sf_dir):
    return usage.group_dim(_memberships(spark, sf_dir))


@QUERIES.query(f"WITH {_MEMBERS} SELECT DISTINCT u AS \"user\" FROM members")
def user_dim(spark, sf_dir):
    return usage.user_dim(_memberships(spark, sf_dir))


@QUERIES.query(f"""WITH {_MEMBERS}, everyone AS (
  SELECT CAST(c_custkey AS VARCHAR) AS eu, 'users' AS eg FROM customer),
joined AS (
  SELECT coalesce(g, eg) AS grp, coalesce(eu, u) AS usr, d
  FROM members FULL JOIN everyone ON g = eg AND u = eu)
SELECT grp AS "group", usr AS user_name, CAST(d AS VARCHAR) AS is_direct_group,
 sha256(concat_ws('||', coalesce(grp, ''), coalesce(usr, ''), CAST(d AS VARCHAR))) AS group_user_id
FROM joined WHERE (usr IS NOT NULL AND grp = 'users') OR grp <> 'users'""")
def group_user_bridge(spark, sf_dir):
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user"))
    bridge = usage.group_user_bridge(_memberships(spark, sf_dir), users)
    return bridge.withColumn("is_direct_group", F.col("is_direct_group").cast("string"))


# ------------------------------------------------------------ run history


def _raw_invocations(spark, sf_dir):
    """Events as job invocations; error events carry variables that do not parse."""
    minute = F.date_trunc("minute", "ts")
    text = "yyyy-MM-dd HH:mm:ss"
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    parsed = F.to_json(
        F.struct(
            F.concat(F.lit("scheduled__"), hour, F.lit("+00:00")).alias(runs.RUN_ID_KEY),
            F.col("value").alias("v"),
        )
    )
    done = minute + F.make_dt_interval(F.lit(0), F.lit(0), F.col("value").cast("int") + 1)
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("invocation_id"),
        F.date_format(minute, text).alias("run_started_at"),
        F.date_format(done, text).alias("run_completed_at"),
        F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(parsed).alias(
            "invocation_vars"
        ),
    )


_RUNS = """invocations AS (
  SELECT event_id AS invocation_id, date_trunc('minute', ts) AS started,
         date_trunc('minute', ts) + to_minutes(CAST(trunc(value) AS INTEGER) + 1) AS completed,
         CASE WHEN event_type <> 'error' THEN date_trunc('hour', ts) END AS run
  FROM events),
rollup AS (
  SELECT run, min(started) AS started, max(completed) AS completed FROM invocations GROUP BY 1)"""


@QUERIES.query(f"""WITH {_RUNS} SELECT invocation_id,
 strftime(started, '%Y-%m-%d %H:%M:%S') AS run_started_at,
 strftime(completed, '%Y-%m-%d %H:%M:%S') AS run_completed_at,
 'scheduled__' || strftime(run, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS cosmos_invocation_id,
 run AS short_cosmos_invocation_id FROM invocations""")
def invocations(spark, sf_dir):
    return runs.invocations(_raw_invocations(spark, sf_dir)).drop("invocation_vars")


@QUERIES.query(f"""WITH {_RUNS} SELECT run AS short_cosmos_invocation_id, started AS run_started_at,
 completed AS run_completed_at,
 date_diff('second', started, completed) AS invocation_duration_seconds,
 date_diff('second', started, completed) / 60 AS invocation_duration_minutes FROM rollup""")
def run_rollup(spark, sf_dir):
    return runs.run_rollup(runs.invocations(_raw_invocations(spark, sf_dir)))


_NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


@QUERIES.query(f"""WITH {_RUNS} SELECT run AS short_cosmos_invocation_id_hour,
 sum(date_diff('second', started, completed) / 60) AS sum_invocation_duration_minutes
FROM rollup WHERE date_trunc('day', run) >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY
 AND date_trunc('day', run) <= TIMESTAMP '{_NOW}' GROUP BY 1 ORDER BY 1 DESC LIMIT 500""")
def metric_hourly(spark, sf_dir):
    rollup = runs.run_rollup(runs.invocations(_raw_invocations(spark, sf_dir)))
    return runs.runtime_history(rollup, _now())


def _results(spark, sf_dir):
    """Orders as node runs: the priority is the node, the price its whole minutes."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("invocation_id"),
        F.col("o_orderpriority").alias("unique_id"),
        (F.round("o_totalprice") * 60).alias("execution_time"),
    )


@QUERIES.query(f"""WITH {_RUNS} SELECT run AS short_cosmos_invocation_id_hour,
 sum(round(o_totalprice)) AS sum_node_execution_time_minutes
FROM orders LEFT JOIN invocations ON o_orderkey = invocation_id
WHERE o_orderpriority = '1-URGENT' AND run >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY
 AND run <= TIMESTAMP '{_NOW}' GROUP BY 1 ORDER BY 1 DESC LIMIT 500""")
def metric_joined_hourly(spark, sf_dir):
    return runs.node_runtime_history(
        _results(spark, sf_dir), runs.invocations(_raw_invocations(spark, sf_dir)), "1-URGENT", _now()
    )


@QUERIES.query("""SELECT date_trunc('quarter', o_orderdate) AS o_orderdate_quarter, o_orderstatus,
 sum(round(o_totalprice)) AS total, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM orders GROUP BY 1, 2""")
def metric_quarterly(spark, sf_dir):
    return metric_query(
        load(spark, sf_dir, "orders"),
        [time_dimension("o_orderdate", "QUARTER"), "o_orderstatus"],
        [
            metric("total", "sum", "round(o_totalprice)"),
            metric("lowest", "min", "o_totalprice"),
            metric("highest", "max", "o_totalprice"),
        ],
        limit=None,
    )


@QUERIES.query("""SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC LIMIT 500""")
def top_orders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return top_n(orders, "o_totalprice", 500)


@QUERIES.query("""SELECT o_custkey, o_orderpriority, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders GROUP BY ALL""")
def metric_all_groups(spark, sf_dir):
    return metric_query(
        load(spark, sf_dir, "orders"),
        ["o_custkey", "o_orderpriority"],
        [metric("least", "min", "o_totalprice"), metric("most", "max", "o_totalprice")],
    )


@QUERIES.query("""SELECT o_orderpriority AS unique_id, o_orderkey AS invocation_id,
 round(o_totalprice) * 60 AS execution_time, last_order, last_customer
FROM orders JOIN (SELECT o_orderpriority AS p, max(o_orderkey) AS last_order,
   max_by(o_custkey, o_orderkey) AS last_customer FROM orders GROUP BY 1) ON p = o_orderpriority""")
def enriched_results(spark, sf_dir):
    """Node runs with the newest metadata of their node."""
    nodes = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("unique_id"),
        F.col("o_orderkey").alias("last_order"),
        F.col("o_custkey").alias("last_customer"),
    )
    latest = keep_latest(nodes, "unique_id", "last_order")
    return enrich_run_results(_results(spark, sf_dir), latest, ["last_order", "last_customer"])


@QUERIES.query("""SELECT CAST(user_id AS VARCHAR) AS unique_id, event_type AS name,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS generated_at, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1""")
def latest_artifacts(spark, sf_dir):
    """Newest row per artifact; the time is text, whose order is lexical."""
    models = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("unique_id"),
        F.col("event_type").alias("name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"),
        "value",
    )
    return runs.latest_artifacts({"models": models})["models"]


_ARTIFACT_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS artifact, CAST(user_id AS VARCHAR) AS unique_id, ts,
 {"event_type" if k % 2 else "CAST(NULL AS VARCHAR)"} AS name, {"value" if k % 3 else "CAST(NULL AS DOUBLE)"} AS value
 FROM events WHERE event_id % 8 = {k}"""
    for k, name in enumerate(runs.LATEST_ARTIFACTS)
)


@QUERIES.query(f"""SELECT artifact, unique_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS generated_at, name, value FROM (
 SELECT *, row_number() OVER (PARTITION BY artifact, unique_id ORDER BY ts DESC) AS n FROM ({_ARTIFACT_SQL})) WHERE n = 1""")
def latest_artifacts_all(spark, sf_dir):
    """All eight artifact tables in one pass; they have different columns."""
    events = load(spark, sf_dir, "events")
    tables = {}
    for k, name in enumerate(runs.LATEST_ARTIFACTS):
        columns = [
            F.col("user_id").cast("string").alias("unique_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"),
            *([F.col("event_type").alias("name")] if k % 2 else []),
            *(["value"] if k % 3 else []),
        ]
        tables[name] = events.filter(F.col("event_id") % 8 == k).select(*columns)
    return runs.all_latest_artifacts(tables)


@QUERIES.query("""SELECT * FROM (VALUES
 ('o_note', 'missing', 'string', NULL, NULL), ('o_totalprice', 'type', 'decimal(12,2)', 'double', NULL),
 ('o_orderpriority', 'unexpected', NULL, 'string', NULL))
 t(column_name, problem, expected_type, actual_type, n_rows)
UNION ALL
SELECT 'o_custkey', 'null', 'bigint', 'bigint', count(*) FROM orders WHERE o_orderkey % 7 = 0 HAVING count(*) > 0""")
def contract(spark, sf_dir):
    """Where orders break their contract, in shape and in rows."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_totalprice",
        "o_orderpriority",
    )
    agreed = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType(), False),
            T.StructField("o_custkey", T.LongType(), False),
            T.StructField("o_totalprice", T.DecimalType(12, 2)),
            T.StructField("o_note", T.StringType()),
        ]
    )
    return contract_failures(orders, agreed)
