"""Sources, sinks and complete jobs on known rows."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from spanmart.operators.metrics import enrich_run_results, joined_explore
from spanmart.plans import runs, shop, usage
from spanmart.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sources and sinks


def test_read_seed(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text('ID,NAME,price\n1,"a, ""b""",3\n2,c,4\n')
    inferred = readers.read_seed(spark, str(path))
    assert rows_of(inferred.select("id", "name", "price")) == [(1, 'a, "b"', 3), (2, "c", 4)]
    declared = readers.read_seed(spark, str(path), "id string, name string, price double")
    assert rows_of(declared) == [("1", 'a, "b"', 3.0), ("2", "c", 4.0)]


def test_seed_with_dates(spark, tmp_path):
    path = tmp_path / "discounts.csv"
    path.write_text(
        "id,discount,valid_from,valid_to\nA,0.25,2023-01-01 00:00:00,9999-12-31 00:00:00\n"
    )
    seed = readers.read_seed(
        spark, str(path), "id string, discount float, valid_from timestamp, valid_to timestamp"
    )
    fact = usage.discount_fact(seed.withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")}))
    assert rows_of(fact) == [("A", 0.25, date(2023, 1, 1), date(9999, 12, 31))]
    assert fact.schema == frame(spark, [], usage.DISCOUNT_SCHEMA).schema


def test_read_table_and_values(spark, tmp_path):
    df = readers.values(spark, [(1, "a")], "id int, name string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert rows_of(readers.read_table(spark, str(tmp_path), "t")) == [(1, "a")]
    sinks.write_table(df, "t_catalog")
    assert rows_of(readers.read_table(spark, "default", "t_catalog")) == [(1, "a")]
    sinks.write_table(df.withColumn("id", F.lit(9)), "t_catalog")
    assert rows_of(spark.table("t_catalog")) == [(9, "a")]
    sinks.write_view(df, "v_session")
    assert spark.table("v_session").count() == 1


def test_append_incremental(spark):
    def rows(*days):
        return frame(spark, [(d, datetime(2024, 1, d)) for d in days], "id int, at timestamp")

    args = ("inc_target", ["at"], "at")
    assert sinks.append_incremental(rows(1, 2), *args).count() == 2
    assert rows_of(sinks.append_incremental(rows(2, 3), *args), "id") == [(1,), (2,), (3,)]
    # A repeated run adds nothing.
    assert sinks.append_incremental(rows(2, 3), *args).count() == 3
    with pytest.raises(ValueError, match="full refresh"):
        sinks.append_incremental(rows(7), *args, full_refresh=True)
    allowed = sinks.append_incremental(rows(7), *args, full_refresh=True, allow_full_refresh=True)
    assert rows_of(allowed, "id") == [(7,)]
    assert sinks.append_incremental(rows(5), *args, full_refresh=True, prod=False).count() == 1


def test_append_with_two_marks_can_be_repeated(spark):
    rows = [(1, datetime(2024, 1, 1), datetime(2024, 1, 5)), (None, datetime(2024, 1, 2), datetime(2024, 1, 6))]
    new = frame(spark, rows, "id int, l_ts timestamp, r_ts timestamp")
    args = ("inc_two_marks", ["l_ts", "r_ts"], "l_ts")
    for _ in range(3):
        assert sinks.append_incremental(new, *args, keys=["id"]).count() == 2
    more = frame(spark, [(2, datetime(2024, 1, 1), datetime(2024, 1, 9))], "id int, l_ts timestamp, r_ts timestamp")
    assert sinks.append_incremental(new.unionByName(more), *args, keys=["id"]).count() == 3


def test_append_to_empty_target(spark):
    df = frame(spark, [(1, datetime(2024, 1, 1))], "id int, at timestamp")
    sinks.write_table(df.limit(0), "inc_empty")
    assert sinks.append_incremental(df, "inc_empty", ["at"], "at").count() == 1


def test_publish(spark):
    df = frame(spark, [(1, "a")], "id int, v string")
    done = sinks.publish_table(
        df, "shared", "things", column_docs={"id": "Key"}, prod=True, share_suffix="team_a_share"
    )
    assert (done.name, done.comment) == ("shared.things", "team a share")
    assert spark.catalog.getTable("shared.things").description == "team a share"
    docs = {c.name: c.description for c in spark.catalog.listColumns("shared.things")}
    assert docs["id"] == "Key"
    secret = sinks.publish_table(df, "shared", "pii", comment="it's", sensitive=True)
    assert secret.name == "default_sensitive.pii"
    with pytest.raises(ValueError):
        sinks.publish_table(df, "shared", "things", prod=True)
    with pytest.raises(ValueError):
        sinks.publish_table(df, "shared", "things", column_docs={"nope": "x"})

    query = "SELECT id FROM shared.things"
    view = sinks.publish_view(spark, query, "shared", "things_view", "c", prod=True, share_suffix="s")
    assert spark.table(view.name).columns == ["id"]
    with pytest.raises(ValueError, match="is a table"):
        sinks.publish_view(spark, query, "shared", "pii", sensitive=True, default_schema="default")
    sinks.publish_view(spark, query, None, "pii", sensitive=True, full_refresh=True)
    assert spark.catalog.getTable("default_sensitive.pii").tableType == "VIEW"
    assert sinks.publish_view(spark, df, None, "session_only").kind == "session view"
    copies = sinks.republish(spark, {"metadata": df, "monitors_runs": df}, None)
    assert [c.name for c in copies] == ["default.share_metadata", "default.share_monitors_runs"]
    assert len(runs.REPUBLISHED) == 19


@pytest.mark.parametrize(
    "custom, sensitive, prod, expected",
    [(None, False, False, "dev"), ("mart", False, False, "dev"), (" mart ", False, True, "mart"),
     ("mart", True, True, "mart_sensitive"), (None, True, True, "dev_sensitive")],
)
def test_target_schema(custom, sensitive, prod, expected):
    assert sinks.target_schema("dev", custom, sensitive, prod) == expected


# ---------------------------------------------------------------- shop


def test_location_opening_becomes_a_date(spark):
    raw = frame(
        spark,
        [(1, "Vice City", 0.2, datetime(2016, 9, 1)),
         (2, "San Andreas", 0.1, datetime(2079, 10, 27, 23, 59, 59, 999900))],
        "id int, name string, tax_rate double, opened_at timestamp",
    )
    assert rows_of(shop.stage_locations(raw), "location_id", "opened_date") == [
        (1, date(2016, 9, 1)), (2, date(2079, 10, 27))
    ]


def test_supply_costs_sum_per_item(spark):
    supplies = frame(
        spark, [(1, Decimal("4.50")), (2, Decimal("3.50")), (2, Decimal("5.00"))],
        "product_id int, supply_cost decimal(16,2)",
    )
    nothing = F.lit(None)
    products = frame(spark, [(1,), (2,)], "product_id int").select(
        "product_id", nothing.alias("product_name"), nothing.alias("product_price"),
        nothing.alias("is_food_item"), nothing.alias("is_drink_item"),
    )
    items = frame(spark, [(1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 2, 9)],
                  "order_item_id int, order_id int, product_id int")
    orders = frame(spark, [(1,), (2,)], "order_id int").withColumn("order_date", nothing.cast("date"))
    out = shop.mart_order_items(items, orders, products, supplies)
    assert rows_of(out, "order_item_id", "order_id", "product_id", "supply_cost") == [
        (1, 1, 1, Decimal("4.50")), (2, 2, 2, Decimal("8.50")), (3, 2, 2, Decimal("8.50")),
        (4, 2, 9, None),
    ]


def test_order_items_become_flags(spark):
    items = frame(
        spark, [(1, 1, False, True), (1, 2, True, False), (2, 3, False, True)],
        "order_id int, order_item_id int, is_drink_item boolean, is_food_item boolean",
    ).withColumns({c: F.lit(1).cast("decimal(16,2)") for c in ("supply_cost", "product_price")})
    orders = frame(spark, [(1, 7, date(2024, 1, 2)), (2, 7, date(2024, 1, 1)), (3, 8, None)],
                   "order_id int, customer_id int, order_date date")
    for hot_rows in (None, 1):
        out = shop.mart_orders(orders, items, hot_rows)
        assert rows_of(
            out, "order_id", "count_food_items", "count_drink_items", "is_drink_order",
            "is_food_order", "customer_order_number",
        ) == [(1, 1, 1, True, True, 2), (2, 1, 0, False, True, 1), (3, None, None, None, None, 1)]


def test_customers_are_new_or_returning(spark):
    orders = frame(
        spark,
        [(1, 7, date(2024, 1, 2), 1, 1, 2), (2, 7, date(2024, 1, 1), 2, 1, 3), (3, 8, date(2024, 5, 5), 1, 0, 1)],
        "order_id int, customer_id int, order_date date, subtotal int, tax_paid int, order_total int",
    )
    customers = frame(spark, [(7, "A"), (8, "B"), (9, "C")], "customer_id int, customer_name string")
    out = shop.mart_customers(customers, orders)
    assert rows_of(out, "customer_id", "count_lifetime_orders", "customer_type", "lifetime_spend") == [
        (7, 2, "returning", 5), (8, 1, "new", 1), (9, None, "new", None)
    ]


def test_build_marts(spark):
    raw = {
        "customers": frame(spark, [("c1", "Ann")], "ID string, NAME string"),
        "stores": frame(spark, [("s1", "Shop", datetime(2020, 1, 1), 0.1)],
                        "id string, name string, opened_at timestamp, tax_rate double"),
        "items": frame(spark, [("i1", "o1", "p1"), ("i2", "o1", "p2")],
                       "id string, order_id string, sku string"),
        "orders": frame(spark, [("o1", "s1", "c1", 900, 90, 990, datetime(2024, 1, 1, 9))],
                        "id string, store_id string, customer string, subtotal int, tax_paid int, "
                        "order_total int, ordered_at timestamp"),
        "products": frame(spark, [("p1", "toast", "jaffle", 500, "x"), ("p2", "tea", "beverage", 400, None)],
                          "sku string, name string, type string, price int, description string"),
        "supplies": frame(spark, [("u1", "bread", 50, True, "p1")],
                          "id string, name string, cost int, perishable boolean, sku string"),
    }
    spark.sql("CREATE DATABASE IF NOT EXISTS marts")
    marts = shop.build_marts(raw, "marts")
    assert set(marts) == {"order_items", "orders", "customers", "locations", "products", "supplies"}
    assert rows_of(marts["orders"], "order_cost", "order_items_subtotal", "is_food_order") == [
        (Decimal("0.50"), Decimal("9.00"), True)
    ]
    assert rows_of(marts["customers"], "customer_type", "lifetime_spend") == [("new", Decimal("9.90"))]


# ---------------------------------------------------------------- usage


def test_memberships(spark):
    members = frame(
        spark,
        [("ann", "admins", True), ("ann", "users", False), ("bob", "admins", None), ("zed", "users", True)],
        "user string, group string, is_direct_group boolean",
    )
    users = frame(spark, [("ann",), ("bob",), ("eve",)], "user string")
    out = usage.group_user_bridge(members, users)
    assert out.columns == ["group", "user_name", "is_direct_group", "group_user_id"]
    assert rows_of(out, "group", "user_name", "is_direct_group") == [
        ("admins", "ann", True), ("admins", "bob", None), ("users", "ann", False),
        ("users", "bob", None), ("users", "eve", None), ("users", "zed", True),
    ]
    assert out.select("group_user_id").distinct().count() == 6
    assert usage.group_dim(members).count() == 2 and usage.user_dim(members).count() == 3


def test_catalog_tables(spark):
    listing = frame(
        spark, [tuple(["c", "s", "t"] + [None] * 11)],
        ", ".join(f"{c} string" for c in usage.TABLE_COLUMNS),
    )
    for system in (False, True):
        row = usage.tables_dim(listing, system).first()
        assert row["information_schema_tables_id"] == "c.s.t"
    shares = frame(spark, [("a", "b", "c")], "catalog_name string, provider_name string, share_name string")
    assert usage.share_usage_dim(shares).first()[0] == "abc"
    warehouses = frame(spark, [("w", "1", "Main")], usage.WAREHOUSE_SCHEMA)
    assert usage.warehouse_dim(warehouses).columns == ["warehouse_id", "workspace_id", "warehouse_name"]


# ---------------------------------------------------------------- run history


def test_run_history(spark):
    key = runs.RUN_ID_KEY
    raw = frame(
        spark,
        [("i1", "2024-01-09 05:00:00", "2024-01-09 05:10:00",
          f'{{"{key}": "scheduled__2024-01-09T05:00:00+00:00", "deep": {{"a": 1}}}}'),
         ("i2", "2024-01-09 05:05:00", "2024-01-09 05:30:00",
          f'{{"{key}": "scheduled__2024-01-09T05:00:00+00:00"}}'),
         ("i3", "2024-01-09 07:00:00", "2024-01-09 07:01:00", "{broken")],
        "invocation_id string, run_started_at string, run_completed_at string, invocation_vars string",
    )
    shared = runs.invocations(raw)
    assert shared.columns == [
        "invocation_id", "run_started_at", "run_completed_at", "invocation_vars",
        "cosmos_invocation_id", "short_cosmos_invocation_id",
    ]
    rollup = runs.run_rollup(shared)
    stamp = datetime(2024, 1, 9, 5)
    assert rows_of(
        rollup, "short_cosmos_invocation_id", "invocation_duration_seconds", "invocation_duration_minutes"
    ) == [(None, 60, 1.0), (stamp, 1800, 30.0)]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert rows_of(runs.runtime_history(rollup, now)) == [(stamp, 30.0)]
    results = frame(
        spark, [("m1", "i1", 120.0), ("m1", "i2", 60.0), ("m2", "i1", 6.0), ("m1", "i9", 6.0)],
        "unique_id string, invocation_id string, execution_time double",
    )
    assert rows_of(runs.node_runtime_history(results, shared, "m1", now)) == [(stamp, 3.0)]
    explore = joined_explore(results, shared, runs.RUN_FIELDS)
    assert explore.count() == 4
    nodes = frame(spark, [("m1", "view")], "unique_id string, materialization string")
    assert enrich_run_results(results, nodes, ["materialization"]).count() == 3


def test_latest_artifacts(spark):
    df = frame(spark, [("a", "2024-01-01", 1), ("a", "2024-01-02", 2)],
               "unique_id string, generated_at string, n int")
    latest = runs.latest_artifacts({name: df for name in runs.LATEST_ARTIFACTS})
    assert len(latest) == 8
    assert all(rows_of(x, "n") == [(2,)] for x in latest.values())
    with pytest.raises(ValueError):
        runs.latest_artifacts({"other": df})


def test_a_table_may_be_replaced_by_a_query_over_itself(spark):
    sinks.write_table(spark.range(5).toDF("id"), "swapped")
    sinks.write_table(spark.table("swapped").selectExpr("id * 2 AS id", "'x' AS v"), "swapped")
    assert rows_of(spark.table("swapped")) == [(0, "x"), (2, "x"), (4, "x"), (6, "x"), (8, "x")]


def test_a_failed_rebuild_leaves_the_old_rows(spark):
    sinks.write_table(spark.range(3).toDF("id"), "steady")
    broken = spark.range(40).select(F.when(F.col("id") > 30, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_table(broken, "steady")
    assert rows_of(spark.table("steady")) == [(0,), (1,), (2,)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("steady__")]


def test_the_mark_reaches_the_scan_and_a_second_run_adds_nothing(spark, tmp_path):
    from spanmart.operators.intervals import newer_than_value, newest_mark

    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=n, microseconds=n)) for n in range(50)]
    spark.createDataFrame(rows, "id int, at timestamp").write.parquet(str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    sinks.write_table(new.filter("id < 20"), "marked")
    for _ in range(2):
        done = sinks.append_incremental(new, "marked", ["at"], "at")
        assert rows_of(done, "id") == [(n,) for n in range(50)]
    held = new.filter("id < 20")
    fresh = newer_than_value(new, ["at"], newest_mark(held, "at"))
    assert "GreaterThan(at,2024-01-01" in fresh._jdf.queryExecution().executedPlan().toString()
    assert rows_of(fresh, "id") == [(n,) for n in range(20, 50)]


def test_history_is_republished_whole(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="missing"):
        runs.republish_history(spark, {"metadata": df}, None)
    done = runs.republish_history(spark, dict.fromkeys(runs.REPUBLISHED, df), "history", default_schema="history")
    assert [d.name.split(".")[1] for d in done] == [f"share_{n}" for n in runs.REPUBLISHED]


def test_artifact_tables_in_one_pass(spark):
    a = spark.createDataFrame([("x", "2024-01-01", 1), ("x", "2024-01-02", 2)], "unique_id string, generated_at string, n int")
    b = spark.createDataFrame([("x", "2024-01-03", "v")], "unique_id string, generated_at string, s string")
    found = runs.all_latest_artifacts({"tests": b, "models": a})
    assert rows_of(found, "artifact", "unique_id", "generated_at", "n", "s") == [
        ("models", "x", "2024-01-02", 2, None), ("tests", "x", "2024-01-03", None, "v"),
    ]
    with pytest.raises(ValueError, match="not artifact"):
        runs.all_latest_artifacts({"nope": a})
