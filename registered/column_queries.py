"""Projections, scalar functions, aggregates, unions, PII and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registered.common import Registry, load
from spanmart.functions.dates import (
    build_date_spine,
    date_spine,
    duration_seconds,
    local_midnight_timestamp,
    localize,
    ms_int_to_time,
    regional_timezones,
    split_str_time_range,
    timestamp_to_utc,
    to_local_date,
    to_report_date,
)
from spanmart.functions.keys import composite_key, flag, label, row_id, surrogate_key
from spanmart.functions.predicates import date_between, equals_any
from spanmart.functions.text import (
    cents_to_dollars,
    json_map_key,
    nullify_empty_strings,
    safe_cast,
    string_to_array,
)
from spanmart.operators.columns import rename_columns, star_except
from spanmart.operators.dedupe import distinct_on, keep_latest
from spanmart.operators.pii import hash_sensitive_columns, nohash_sensitive_columns, tag_columns
from spanmart.operators.quality import (
    check_accepted_values,
    check_expression,
    check_not_null,
    check_relationship,
    check_unique,
    source_freshness,
)
from spanmart.operators.unions import union_columns, union_territories
from spanmart.sources.readers import values
from spanmart.sources.sinks import write_view

QUERIES = Registry()
SALT = "test-salt"


def _text_date(col):
    return F.date_format(col, "yyyy-MM-dd")


# ------------------------------------------------------------ one row per key


@QUERIES.query("""SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
 max_by(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice,
 max(o_orderdate) AS o_orderdate, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
FROM orders GROUP BY o_custkey""")
def distinct_on_max(spark, sf_dir):
    return distinct_on(
        load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
        ["o_orderstatus", "o_totalprice"],
    )


@QUERIES.query("""SELECT l_returnflag, l_linestatus, min_by(l_partkey, k) AS l_partkey,
 min(l_shipdate) AS l_shipdate, min_by(l_orderkey, k) AS l_orderkey,
 min_by(l_linenumber, k) AS l_linenumber, min_by(l_suppkey, k) AS l_suppkey
FROM (SELECT *, (l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem)
GROUP BY l_returnflag, l_linestatus""")
def distinct_on_min(spark, sf_dir):
    """A handful of keys hold the whole table; rows are combined before the shuffle."""
    return distinct_on(
        load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], ["l_partkey"], method="MIN",
    )


@QUERIES.query("""SELECT user_id,
 max_by(clicked, event_id) FILTER (WHERE clicked IS NOT NULL) AS clicked,
 max_by(bought, event_id) FILTER (WHERE bought IS NOT NULL) AS bought, max(event_id) AS event_id
FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS clicked,
      CASE WHEN event_type = 'purchase' THEN value END AS bought FROM events)
GROUP BY user_id""")
def distinct_on_skip_nulls(spark, sf_dir):
    """Latest known value of each kind per user."""
    kinds = {"clicked": "click", "bought": "purchase"}
    events = load(spark, sf_dir, "events").withColumns(
        {name: F.when(F.col("event_type") == kind, F.col("value")) for name, kind in kinds.items()}
    )
    return distinct_on(events, ["user_id"], ["event_id"], list(kinds), skip_nulls=True)


@QUERIES.query("""SELECT event_id, ts, user_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
 FROM events) WHERE n = 1""")
def keep_latest_event(spark, sf_dir):
    latest = keep_latest(
        load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]
    )
    return star_except(latest, ["props"])


# ------------------------------------------------------------ unions


def _parties(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("party"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = load(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"),
        F.col("s_name").alias("party"),
    )
    return customers, suppliers


@QUERIES.query("""SELECT c_name AS party, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier""")
def union_all(spark, sf_dir):
    return union_columns(*_parties(spark, sf_dir), ["party", "nation", "balance"])


@QUERIES.query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return union_columns(*_parties(spark, sf_dir), ["nation"], kind="distinct")


@QUERIES.query("""SELECT c_nationkey AS nation, c_name AS party, c_acctbal AS balance FROM customer
UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier""")
def union_all_territories(spark, sf_dir):
    contract = T.StructType(
        [
            T.StructField("nation", T.IntegerType()),
            T.StructField("party", T.StringType()),
            T.StructField("balance", T.DoubleType()),
        ]
    )
    return union_territories(list(_parties(spark, sf_dir)), contract)


# ------------------------------------------------------------ dates and zones


@QUERIES.query("""SELECT strftime(d, '%Y-%m-%d') AS date_day, count(o_orderkey) AS n_orders
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d
      FROM orders) LEFT JOIN orders ON o_orderdate = d GROUP BY d""")
def date_spine_day(spark, sf_dir):
    """Orders per day, with a row for days that have none."""
    orders = load(spark, sf_dir, "orders")
    # Two values: the first and last day, both included.
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    counts = orders.groupBy(F.col("o_orderdate").cast("timestamp").alias("date_day")).agg(
        F.count("o_orderkey").alias("n_orders")
    )
    spine = date_spine(spark, "day", str(first), str(last))
    return spine.join(counts, "date_day", "left").select(
        _text_date("date_day").alias("date_day"), F.coalesce("n_orders", F.lit(0)).alias("n_orders")
    )


@QUERIES.query("""SELECT strftime(d, '%Y-%m-%d') AS date_day, strftime(d, '%a') AS day_of_week,
 strftime(d, '%a') IN ('Sat', 'Sun') AS is_weekend, count(o_orderkey) AS n_orders
FROM (SELECT unnest(range(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
LEFT JOIN orders ON o_orderdate = d GROUP BY d""")
def date_table(spark, sf_dir):
    """Day table whose end is excluded, with orders per day."""
    orders = load(spark, sf_dir, "orders")
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    counts = orders.groupBy(F.to_date("o_orderdate").alias("date_day")).agg(
        F.count("o_orderkey").alias("n_orders")
    )
    return build_date_spine(spark, str(first), str(last)).join(counts, "date_day", "left").select(
        _text_date("date_day").alias("date_day"),
        "day_of_week",
        "is_weekend",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
    )


_LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE '{}'"


@QUERIES.query(f"""SELECT event_id, ts AS utc, {_LOCAL.format('America/Chicago')} AS local_time,
 strftime({_LOCAL.format('America/Chicago')}, '%Y-%m-%d') AS local_date,
 strftime(ts, '%Y-%m-%d') AS utc_date FROM events""")
def local_dates(spark, sf_dir):
    tz = "America/Chicago"
    return load(spark, sf_dir, "events").select(
        "event_id",
        timestamp_to_utc("ts").alias("utc"),
        localize("ts", tz).alias("local_time"),
        _text_date(to_local_date("ts", tz=tz)).alias("local_date"),
        _text_date(to_local_date("ts", localized=False)).alias("utc_date"),
    )


@QUERIES.query("SELECT event_id, " + ", ".join(
    f"{_LOCAL.format(zone)} AS ts_{city}_tz" for city, zone in {
        "london": "Europe/London", "paris": "Europe/Paris", "berlin": "Europe/Berlin",
        "tokyo": "Asia/Tokyo", "wellington": "Pacific/Auckland", "texas": "America/Chicago",
        "madrid": "Europe/Madrid"}.items()) + " FROM events")
def regional_times(spark, sf_dir):
    return regional_timezones(load(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@QUERIES.query(f"""SELECT event_id, (date_trunc('day', {_LOCAL.format('Asia/Tokyo')})
 AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS midnight FROM events""")
def local_midnight(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", local_midnight_timestamp("ts", "Asia/Tokyo").alias("midnight")
    )


@QUERIES.query("""SELECT o_orderkey, strftime(CASE WHEN CAST(o_orderdate AS DATE) > DATE '1999-05-31'
 THEN DATE '1999-06-15' ELSE last_day(o_orderdate) END, '%Y-%m-%d') AS report_date FROM orders""")
def report_date(spark, sf_dir):
    now = F.lit("1999-06-15 10:00:00").cast("timestamp")
    date = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", _text_date(to_report_date(date, now=now)).alias("report_date")
    )


@QUERIES.query("""SELECT event_id, strftime(TIMESTAMP '1970-01-01' + to_milliseconds(ms), '%H:%M:%S')
 AS time_of_day FROM (SELECT event_id, (event_id * 7919000) % 86400000 AS ms FROM events)""")
def ms_time(spark, sf_dir):
    ms = (F.col("event_id") * 7919000) % 86400000 + F.lit(-1462009856)
    return load(spark, sf_dir, "events").select(
        "event_id",
        # The interval as text: INTERVAL '03:02:01' HOUR TO SECOND.
        F.regexp_extract(ms_int_to_time(ms).cast("string"), "'(.*)'", 1).alias("time_of_day"),
    )


@QUERIES.query("""SELECT o_orderkey, o_orderdate AS starts,
 CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2099-12-31 23:59:59'
      ELSE o_orderdate + INTERVAL 30 DAY END AS ends FROM orders""")
def time_range(spark, sf_dir):
    """Periods written as range text and read back; open orders have no end."""
    orders = load(spark, sf_dir, "orders")

    def quoted(col):
        return F.concat(F.lit('"'), F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.lit('+00"'))

    end = F.when(
        F.col("o_orderstatus") != "O", quoted(F.col("o_orderdate") + F.make_dt_interval(F.lit(30)))
    ).otherwise(F.lit(""))
    text = F.concat(F.lit("["), quoted(F.col("o_orderdate")), F.lit(","), end, F.lit(")"))
    return orders.select("o_orderkey", text.alias("period")).select(
        "o_orderkey",
        split_str_time_range("period").alias("starts"),
        split_str_time_range("period", start_period=False).alias("ends"),
    )


@QUERIES.query("""SELECT o_orderkey, o_orderdate, date_diff('second', o_orderdate, l) AS seconds
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1)
 ON l_orderkey = o_orderkey
WHERE TIMESTAMP '1996-01-01' <= o_orderdate AND o_orderdate < coalesce(
  CASE WHEN o_orderstatus = 'F' THEN l END, TIMESTAMP '2099-12-31 23:59:59')""")
def between_dates(spark, sf_dir):
    """A filter on validity, and durations in seconds."""
    items = load(spark, sf_dir, "lineitem")
    last = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    orders = load(spark, sf_dir, "orders")
    below = F.lit(None).cast("timestamp_ntz")
    above = F.when(F.col("o_orderstatus") == "F", F.col("shipped"))
    valid = date_between("o_orderdate", below, above, F.lit("1996-01-01").cast("timestamp_ntz"))
    return orders.join(last, orders.o_orderkey == last.l_orderkey).filter(valid).select(
        "o_orderkey", "o_orderdate", duration_seconds("o_orderdate", "shipped").alias("seconds")
    )


# ------------------------------------------------------------ text, money, JSON


@QUERIES.query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag)
 AS flags, count(DISTINCT l_returnflag) AS n_flags FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT o_orderkey, '', 0 FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def string_array(spark, sf_dir):
    """Return flags of an order written as array text and read back."""
    items = load(spark, sf_dir, "lineitem")
    flags = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    written = orders.join(flags, "l_orderkey", "left").select(
        "l_orderkey",
        F.when(F.col("f").isNull(), F.lit("[]"))
        .otherwise(F.concat(F.lit('["'), F.array_join("f", '","'), F.lit('"]')))
        .alias("text"),
    )
    parsed = written.select("l_orderkey", string_to_array("text").alias("f"))
    return parsed.select(
        "l_orderkey",
        F.array_join("f", "|").alias("flags"),
        F.size("f").cast("long").alias("n_flags"),
    )


@QUERIES.query("""SELECT doc_id, lang, nullif(trim(text), '') AS body,
 nullif(source, '') AS source FROM documents""")
def nullify(spark, sf_dir):
    """Whole document texts, blank ones as NULL."""
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        nullify_empty_strings(F.trim("text"), "body"),
        nullify_empty_strings("source"),
    )


@QUERIES.query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
 CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DECIMAL(16, 2)) / 100 AS DOUBLE) AS price
FROM lineitem""")
def cents(spark, sf_dir):
    amount = F.round(F.col("l_extendedprice") * 100).cast("long")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        cents_to_dollars(amount).cast("double").alias("price"),
    )


@QUERIES.query("""SELECT event_id, json_extract_string(props, '$.k') AS k,
 try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k_number,
 try_cast(event_type AS INTEGER) AS not_a_number FROM events""")
def json_map_key_events(spark, sf_dir):
    k = json_map_key("props", "k")
    return load(spark, sf_dir, "events").select(
        "event_id",
        k.alias("k"),
        safe_cast(k, "int").alias("k_number"),
        safe_cast("event_type", "int").alias("not_a_number"),
    )


# ------------------------------------------------------------ keys, flags, filters


@QUERIES.query("""SELECT s_suppkey, md5(coalesce(CAST(s_suppkey AS VARCHAR), '_dbt_utils_surrogate_key_null_')
 || '-' || coalesce(CASE WHEN s_nationkey > 10 THEN s_name END, '_dbt_utils_surrogate_key_null_'))
 AS supplier_key FROM supplier""")
def surrogate_key_supplier(spark, sf_dir):
    name = F.when(F.col("s_nationkey") > 10, F.col("s_name"))
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", surrogate_key("s_suppkey", name).alias("supplier_key")
    )


@QUERIES.query("""SELECT s_suppkey, CASE WHEN s_nationkey > 10 THEN s_name END || '.' || n_name || '.'
 || CAST(s_suppkey AS VARCHAR) AS full_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def composite_key_supplier(spark, sf_dir):
    suppliers, nations = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    named = F.when(F.col("s_nationkey") > 10, F.col("s_name"))
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        "s_suppkey", composite_key(named, "n_name", "s_suppkey").alias("full_name")
    )


@QUERIES.query("""SELECT o_orderkey AS order_id, o_orderpriority AS priority,
 coalesce(o_orderstatus = 'F', false) AS is_final,
 CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size
FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH'""")
def flags_and_labels(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").filter(
        equals_any("o_orderpriority", ["1-URGENT", "2-HIGH", None])
    )
    named = rename_columns(
        orders,
        {"o_orderkey": "order_id", "o_orderpriority": "priority", "o_orderstatus": "status",
         "o_totalprice": "price"},
    )
    return named.select(
        "order_id",
        "priority",
        flag(F.col("status") == "F").alias("is_final"),
        label(F.col("price") > 250000, "large", "small").alias("size"),
    )


@QUERIES.query("SELECT count(*) AS n_rows, count(*) AS n_ids FROM lineitem")
def row_ids(spark, sf_dir):
    """Row ids are unique over the whole table."""
    numbered = load(spark, sf_dir, "lineitem").select(row_id().alias("id"))
    return numbered.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids")
    )


# ------------------------------------------------------------ PII


def _tagged_customers(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    return tag_columns(customers, ["c_name", "c_acctbal"])


@QUERIES.query(f"""SELECT sha256(trim(lower(c_name || '{SALT}'))) AS c_name_hash,
 sha256(trim(lower(CAST(CAST(c_custkey AS BIGINT) AS VARCHAR) || '{SALT}'))) AS c_custkey_hash,
 c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def hash_sensitive(spark, sf_dir):
    customers = tag_columns(load(spark, sf_dir, "customer"), ["c_name", "c_custkey"])
    return hash_sensitive_columns(customers, salt=SALT)


@QUERIES.query(f"""SELECT sha256(trim(lower(CAST(c_custkey AS VARCHAR) || '{SALT}'))) AS c_custkey_hash,
 c_name, c_acctbal FROM customer""")
def nohash_sensitive(spark, sf_dir):
    return nohash_sensitive_columns(_tagged_customers(spark, sf_dir), "c_custkey", SALT)


# ------------------------------------------------------------ quality checks


@QUERIES.query("""SELECT o_orderkey FROM (SELECT o_orderkey,
 CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS c FROM orders) WHERE c IS NULL""")
def check_not_null_rows(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("c")
    )
    return check_not_null(orders, "c").select("o_orderkey")


@QUERIES.query("""SELECT l_orderkey, count(*) AS n_records FROM lineitem
WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def check_unique_rows(spark, sf_dir):
    return check_unique(load(spark, sf_dir, "lineitem"), "l_orderkey")


@QUERIES.query("""SELECT o_orderpriority, count(*) AS n_records FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def check_accepted_values_rows(spark, sf_dir):
    return check_accepted_values(
        load(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    )


@QUERIES.query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def check_relationship_rows(spark, sf_dir):
    """Orders whose customer is missing among those with a positive balance."""
    good = load(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return check_relationship(orders, "o_custkey", good, "c_custkey")


@QUERIES.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE NOT (l_extendedprice * (1 - l_discount) < 50000)""")
def check_expression_rows(spark, sf_dir):
    items = check_expression(
        load(spark, sf_dir, "lineitem"), "l_extendedprice * (1 - l_discount) < 50000"
    )
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@QUERIES.query("""SELECT o_orderkey, o_orderpriority, days FROM orders
JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 3), (NULL, 9)) AS promised(priority, days)
  ON o_orderpriority = priority""")
def literal_rows_join(spark, sf_dir):
    """Orders, read through a view, joined with literal rows."""
    write_view(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "literal_rows_orders")
    promised = values(spark, [("1-URGENT", 1), ("2-HIGH", 3), (None, 9)], "priority string, days int")
    orders = spark.table("literal_rows_orders")
    return orders.join(promised, orders.o_orderpriority == promised.priority).drop("priority")


@QUERIES.query("""SELECT 'orders' AS source, max(o_orderdate) AS max_loaded_at FROM orders
UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', max(ts) FROM events""")
def freshness(spark, sf_dir):
    fields = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    found = [source_freshness(load(spark, sf_dir, t), c, t) for t, c in fields.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
