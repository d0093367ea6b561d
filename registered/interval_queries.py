"""Interval operators on order and shipment periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.common import (
    FAR,
    PERIODS_SQL,
    SHIPMENTS_SQL,
    Registry,
    load,
    periods,
    sequence_sql,
    shipments,
)
from spanmart.operators.flatten import (
    flatten_sequential_rows,
    flatten_sequential_rows_mixed_datatypes,
    flatten_sequential_rows_no_value_cols,
)
from spanmart.operators.hotkeys import find_hot_keys
from spanmart.operators.interval_joins import (
    PAIR_ROWS,
    common_interval_join,
    extend_back,
    interval_overlap_join,
    point_in_interval_join,
)
from spanmart.operators.intervals import (
    get_overlap_detail,
    merge_sequential_intervals,
    newer_than,
    sequentialize_table,
)
from spanmart.operators.ordinals import running_ordinal

QUERIES = Registry()
KEY, START, END = "o_custkey", "valid_from", "valid_to"

# ------------------------------------------------------------ sequentialize

_SEQ = sequence_sql(
    "seq", "periods", KEY, START, END, "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"]
)


@QUERIES.query(f"""WITH {PERIODS_SQL}, {_SEQ}
SELECT o_custkey, a AS valid_from, b AS valid_to, o_orderkey, o_orderstatus, o_orderpriority,
       n > 1 AS is_overlapping FROM seq""")
def sequentialize_orders(spark, sf_dir):
    """Each customer's effective order over time, and where orders overlap."""
    return sequentialize_table(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderkey"],
        flag_overlaps_column="is_overlapping",
    )


def _by_status(spark, sf_dir):
    return periods(spark, sf_dir).select("o_orderstatus", "o_orderkey", "o_custkey", START, END)


_SEQ_STATUS = sequence_sql(
    "seq", "periods", "o_orderstatus", START, END, "o_orderkey", ["o_orderkey", "o_custkey"]
)


@QUERIES.query(f"""WITH {PERIODS_SQL}, {_SEQ_STATUS}
SELECT o_orderstatus, a AS valid_from, b AS valid_to, o_orderkey, o_custkey,
       n > 1 AS is_overlapping FROM seq""")
def sequentialize_hot_keys(spark, sf_dir):
    """Three keys hold a third of the rows each, nearly all overlapping."""
    return sequentialize_table(
        _by_status(spark, sf_dir), ["o_orderstatus"], START, END, ["o_orderkey"],
        flag_overlaps_column="is_overlapping", hot_rows=1000,
    )


_SKEWED_SQL = f"""{PERIODS_SQL}, skewed AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS account, o_orderkey,
         o_orderpriority, valid_from, valid_to FROM periods)"""


def _skewed(spark, sf_dir):
    """One account holds a third of all periods; the rest stays with its customer."""
    account = F.when(F.col("o_orderstatus") == "F", F.lit(-1)).otherwise(F.col("o_custkey"))
    return periods(spark, sf_dir).select(
        account.cast("long").alias("account"), "o_orderkey", "o_orderpriority", START, END
    )


@QUERIES.query(f"""WITH {_SKEWED_SQL}, {sequence_sql(
    "seq", "skewed", "account", START, END, "o_orderkey", ["o_orderkey", "o_orderpriority"])}
SELECT account, a AS valid_from, b AS valid_to, o_orderkey, o_orderpriority,
       n > 1 AS is_overlapping FROM seq""")
def sequentialize_skewed(spark, sf_dir):
    return sequentialize_table(
        _skewed(spark, sf_dir), ["account"], START, END, ["o_orderkey"],
        flag_overlaps_column="is_overlapping",
    )


_SENTINEL_SQL = f"""{PERIODS_SQL}, closed AS (
  SELECT o_orderstatus, o_orderkey, o_custkey, valid_from,
         coalesce(valid_to, TIMESTAMP '9999-12-31') AS valid_to FROM periods)"""


@QUERIES.query(f"""WITH {_SENTINEL_SQL}, {sequence_sql(
    "seq", "closed", "o_orderstatus", START, END, "o_orderkey", ["o_orderkey", "o_custkey"])}
SELECT o_orderstatus, a AS valid_from, b AS valid_to, o_orderkey, o_custkey,
       n > 1 AS is_overlapping FROM seq""")
def sequentialize_sentinel_end(spark, sf_dir):
    """Open ends written as a date far away: the timeline is cut where the rows are, not by its width."""
    closed = F.coalesce(END, F.lit("9999-12-31").cast("timestamp_ntz"))
    return sequentialize_table(
        _by_status(spark, sf_dir).withColumn(END, closed), ["o_orderstatus"], START, END,
        ["o_orderkey"], flag_overlaps_column="is_overlapping", hot_rows=1000,
    )


_FILTERED = PERIODS_SQL.replace("FROM orders", "FROM orders WHERE o_orderstatus <> 'P'")


@QUERIES.query(f"""WITH {_FILTERED}, {sequence_sql("seq", "periods", KEY, START, END, "o_orderkey", [])}
SELECT o_custkey, a AS valid_from, b AS valid_to FROM seq""")
def sequentialize_no_values(spark, sf_dir):
    return sequentialize_table(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderkey"],
        pre_filter=F.col("o_orderstatus") != "P", value_cols=[],
    )


_DETAIL = f"""WITH {PERIODS_SQL}, {sequence_sql("seq", "periods", KEY, START, END, "o_orderkey", [])}
SELECT t.o_custkey, t.o_orderkey, t.o_orderstatus, t.o_orderpriority, t.valid_from, t.valid_to,
       s.a AS overlap_start, s.b AS overlap_end
FROM seq s JOIN periods t ON t.o_custkey = s.o_custkey
 AND s.a < coalesce(t.valid_to, TIMESTAMP '9999-12-31')
 AND coalesce(s.b, TIMESTAMP '9999-12-31') > t.valid_from
WHERE s.n > 1"""


@QUERIES.query(_DETAIL)
def overlap_detail(spark, sf_dir):
    return get_overlap_detail(periods(spark, sf_dir), [KEY], START, END, ["o_orderkey"])


@QUERIES.query(_DETAIL)
def overlap_detail_sliced(spark, sf_dir):
    """Same rows with the busier customers on the sliced path."""
    return get_overlap_detail(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderkey"], hot_rows=12
    )


# ------------------------------------------------------------ merge

_MERGE = f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL},
{sequence_sql("l", "periods", KEY, START, END, "o_orderkey", ["o_orderstatus", "o_orderpriority"])},
{sequence_sql("r", "shipments", KEY, "ship_from", "ship_to", "shipment, part", ["o_orderstatus", "shipment"])},
merge_points AS (
  SELECT DISTINCT o_custkey, p FROM (
    SELECT o_custkey, unnest([a, b]) AS p FROM l UNION ALL SELECT o_custkey, unnest([a, b]) FROM r)
  WHERE p IS NOT NULL),
pieces AS (
  SELECT o_custkey, p AS a, lead(p) OVER (PARTITION BY o_custkey ORDER BY p) AS b FROM merge_points),
merged AS (
  SELECT m.o_custkey, m.a AS interval_start, m.b AS interval_end,
         l.o_orderstatus AS left_o_orderstatus, l.o_orderpriority AS o_orderpriority,
         r.o_orderstatus AS right_o_orderstatus, r.shipment AS shipment,
         l.o_custkey IS NOT NULL AS in_left, r.o_custkey IS NOT NULL AS in_right
  FROM pieces m
  LEFT JOIN l ON l.o_custkey = m.o_custkey AND l.a < coalesce(m.b, {FAR})
        AND coalesce(l.b, {FAR}) > m.a
  LEFT JOIN r ON r.o_custkey = m.o_custkey AND r.a < coalesce(m.b, {FAR})
        AND coalesce(r.b, {FAR}) > m.a)
"""
_MERGED = "o_custkey, interval_start, interval_end"
_BOTH = f"{_MERGED}, left_o_orderstatus, o_orderpriority, right_o_orderstatus, shipment"


def _timelines(spark, sf_dir, hot):
    left = sequentialize_table(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderkey"],
        value_cols=["o_orderstatus", "o_orderpriority"], hot_rows=hot,
    )
    right = sequentialize_table(
        shipments(spark, sf_dir), [KEY], "ship_from", "ship_to", ["shipment", "part"],
        value_cols=["o_orderstatus", "shipment"], hot_rows=hot,
    )
    return left, right


def _merge(spark, sf_dir, hot_rows=PAIR_ROWS, **options):
    left, right = periods(spark, sf_dir), shipments(spark, sf_dir)
    # Counted once, on the sources, for all three operators.
    hot = find_hot_keys([left, right], [KEY], hot_rows).with_bounds(
        (left, START, END), (right, "ship_from", "ship_to")
    )
    options["hot_rows"] = hot
    left, right = _timelines(spark, sf_dir, hot)
    return merge_sequential_intervals(
        left, right, [KEY], START, END, ["o_orderstatus", "o_orderpriority"],
        "ship_from", "ship_to", ["o_orderstatus", "shipment"], **options,
    )


@QUERIES.query(f"{_MERGE} SELECT {_BOTH} FROM merged WHERE in_left")
def merge_intervals_left(spark, sf_dir):
    return _merge(spark, sf_dir, sequential=True)


@QUERIES.query(f"{_MERGE} SELECT {_BOTH} FROM merged WHERE in_left OR in_right")
def merge_intervals_outer(spark, sf_dir):
    return _merge(spark, sf_dir, join_type="outer", sequential=True)


@QUERIES.query(f"{_MERGE} SELECT {_BOTH} FROM merged WHERE in_left OR in_right")
def merge_intervals_sliced(spark, sf_dir):
    """Same rows with the busier customers on the sliced path."""
    return _merge(spark, sf_dir, join_type="outer", sequential=True, hot_rows=60)


@QUERIES.query(f"""{_MERGE} SELECT {_MERGED}, left_o_orderstatus AS o_orderstatus,
o_orderpriority, shipment FROM merged WHERE in_left""")
def merge_intervals_common_left(spark, sf_dir):
    return _merge(spark, sf_dir, common="left")


@QUERIES.query(f"""{_MERGE} SELECT {_MERGED}, o_orderpriority,
right_o_orderstatus AS o_orderstatus, shipment FROM merged WHERE in_left""")
def merge_intervals_common_right(spark, sf_dir):
    return _merge(spark, sf_dir, common="right")


_RAW_MERGE = f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL}, points AS (
  SELECT DISTINCT o_custkey, p FROM (
    SELECT o_custkey, unnest([valid_from, valid_to]) AS p FROM periods
    UNION ALL SELECT o_custkey, unnest([ship_from, ship_to]) FROM shipments)
  WHERE p IS NOT NULL),
pieces AS (
  SELECT o_custkey, p AS a, lead(p) OVER (PARTITION BY o_custkey ORDER BY p) AS b FROM points)
SELECT m.o_custkey, m.a AS interval_start, m.b AS interval_end, l.o_orderkey, r.shipment
FROM pieces m
LEFT JOIN periods l ON l.o_custkey = m.o_custkey AND l.valid_from < coalesce(m.b, {FAR})
      AND coalesce(l.valid_to, {FAR}) > m.a
LEFT JOIN shipments r ON r.o_custkey = m.o_custkey AND r.ship_from < coalesce(m.b, {FAR})
      AND coalesce(r.ship_to, {FAR}) > m.a
WHERE l.o_custkey IS NOT NULL OR r.o_custkey IS NOT NULL"""


def _merge_raw(spark, sf_dir, **options):
    return merge_sequential_intervals(
        periods(spark, sf_dir), shipments(spark, sf_dir), [KEY], START, END, ["o_orderkey"],
        "ship_from", "ship_to", ["shipment"], join_type="outer", **options,
    )


@QUERIES.query(_RAW_MERGE)
def merge_overlapping(spark, sf_dir):
    """Tables whose own rows overlap: every combination of a piece is kept."""
    return _merge_raw(spark, sf_dir)


@QUERIES.query(_RAW_MERGE)
def merge_overlapping_sliced(spark, sf_dir):
    return _merge_raw(spark, sf_dir, hot_rows=60)


@QUERIES.query(f"""{_MERGE} SELECT {_BOTH} FROM merged WHERE (in_left OR in_right)
AND interval_start > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')""")
def merge_incremental(spark, sf_dir):
    """The pieces that a table which ends in 1996 does not have yet."""
    held = load(spark, sf_dir, "orders").filter(
        F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    )
    return _merge(
        spark, sf_dir, join_type="outer", sequential=True,
        incremental=(held, ["interval_start"], "o_orderdate"),
    )


# ------------------------------------------------------------ flatten


def _flatten_sql(group: str, compare: str | None, keep_open: bool = False) -> str:
    order = f"valid_from ASC NULLS FIRST, valid_to ASC NULLS FIRST" + (
        f", {compare}" if compare else ""
    )
    window = f"(PARTITION BY {group} ORDER BY {order})"
    same = f" AND lag({compare}) OVER {window} = {compare}" if compare else ""
    out = f"{group}, {compare}" if compare else group
    last = "max(valid_to)"
    if keep_open:
        last = "CASE WHEN NOT bool_or(valid_to IS NULL) THEN max(valid_to) END"
    return f"""WITH {PERIODS_SQL}, marked AS (
  SELECT *, CASE WHEN lag(valid_to) OVER {window} >= valid_from{same} THEN 0 ELSE 1 END AS fresh
  FROM periods),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island
  FROM marked)
SELECT {out}, min(valid_from) AS valid_from, {last} AS valid_to
FROM islands GROUP BY {out}, island"""


@QUERIES.query(_flatten_sql("o_custkey", "o_orderstatus"))
def flatten_rows(spark, sf_dir):
    return flatten_sequential_rows(periods(spark, sf_dir), [KEY], START, END, ["o_orderstatus"])


@QUERIES.query(_flatten_sql("o_custkey", "o_orderstatus", keep_open=True))
def flatten_rows_keep_open(spark, sf_dir):
    return flatten_sequential_rows(
        periods(spark, sf_dir), [KEY], START, END,
        exclude_cols=["o_orderkey", "o_orderpriority"], keep_open_end=True,
    )


@QUERIES.query(_flatten_sql("o_custkey, o_orderstatus", None))
def flatten_mixed(spark, sf_dir):
    return flatten_sequential_rows_mixed_datatypes(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderstatus"]
    )


@QUERIES.query(
    _flatten_sql("o_custkey, o_orderstatus", None).replace(
        "FROM periods)", "FROM periods WHERE o_orderpriority <> '5-LOW')"
    )
)
def flatten_preset_filter(spark, sf_dir):
    return flatten_sequential_rows_mixed_datatypes(
        periods(spark, sf_dir), [KEY], START, END, ["o_orderstatus"],
        preset_filter=F.col("o_orderpriority") != "5-LOW",
    )


@QUERIES.query(_flatten_sql("o_custkey", None))
def flatten_no_values(spark, sf_dir):
    return flatten_sequential_rows_no_value_cols(periods(spark, sf_dir), [KEY], START, END)


@QUERIES.query(
    _flatten_sql("account", "o_orderpriority")
    .replace(PERIODS_SQL, _SKEWED_SQL)
    .replace("FROM periods),\nislands", "FROM skewed),\nislands")
)
def flatten_skewed(spark, sf_dir):
    return flatten_sequential_rows(
        _skewed(spark, sf_dir), ["account"], START, END, ["o_orderpriority"], hot_rows=2000
    )


@QUERIES.query(_flatten_sql("o_orderpriority", "o_orderstatus"))
def flatten_hot_keys(spark, sf_dir):
    """Five keys hold all rows; islands are found in slices and joined across them."""
    return flatten_sequential_rows(
        periods(spark, sf_dir), ["o_orderpriority"], START, END, ["o_orderstatus"], hot_rows=500
    )


# ------------------------------------------------------------ joins


def _customer_terms(spark, sf_dir):
    """Account terms per customer, derived from the first order date and the key."""
    orders = load(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("term_from"))
    return first.select(
        "o_custkey",
        "term_from",
        (F.col("term_from") + F.make_dt_interval((F.col("o_custkey") % 900 + 300).cast("int"))).alias(
            "term_to"
        ),
    )


_TERMS_SQL = """terms AS (
  SELECT o_custkey, min(o_orderdate) AS term_from,
         min(o_orderdate) + to_days(CAST(o_custkey % 900 + 300 AS INTEGER)) AS term_to
  FROM orders GROUP BY o_custkey)"""
_JOIN_N = f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL}, {_TERMS_SQL}
SELECT p.o_custkey, p.o_orderkey, p.valid_from, p.valid_to, s.shipment, s.ship_from, s.ship_to,
       t.term_from, t.term_to,
       greatest(p.valid_from, s.ship_from, t.term_from) AS interval_start,
       least(p.valid_to, s.ship_to, t.term_to) AS interval_end
FROM periods p JOIN shipments s ON p.o_custkey = s.o_custkey
JOIN terms t ON p.o_custkey = t.o_custkey
WHERE greatest(p.valid_from, s.ship_from, t.term_from) < least(p.valid_to, s.ship_to, t.term_to)"""


def _join_n(spark, sf_dir, **options):
    tables = [
        (periods(spark, sf_dir).select(KEY, "o_orderkey", START, END), START, END),
        (shipments(spark, sf_dir).drop("o_orderstatus", "part"), "ship_from", "ship_to"),
        (_customer_terms(spark, sf_dir), "term_from", "term_to"),
    ]
    return common_interval_join(tables, [KEY], **options)


@QUERIES.query(_JOIN_N)
def interval_join_n(spark, sf_dir):
    return _join_n(spark, sf_dir)


@QUERIES.query(_JOIN_N)
def interval_join_n_sliced(spark, sf_dir):
    """Same rows with the busier customers matched through time buckets."""
    return _join_n(spark, sf_dir, hot_rows=50)


@QUERIES.query(f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL}, a AS (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ns(valid_from) END AS from_ns,
         epoch_ns(valid_to) AS to_ns FROM periods),
b AS (
  SELECT o_custkey, shipment, epoch_ns(ship_from) AS ship_from_ns,
         CASE WHEN part % 2 = 0 THEN epoch_ns(ship_to) END AS ship_to_ns FROM shipments)
SELECT a.o_custkey, o_orderkey, from_ns, to_ns, shipment, ship_from_ns, ship_to_ns,
       greatest(from_ns, ship_from_ns) AS interval_start, least(to_ns, ship_to_ns) AS interval_end
FROM a JOIN b ON a.o_custkey = b.o_custkey
WHERE greatest(from_ns, ship_from_ns) < least(to_ns, ship_to_ns)""")
def interval_join_nanoseconds(spark, sf_dir):
    """Bounds as epoch nanoseconds, beyond 2^60, many of them open; busier customers on the hot path."""
    nanos = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    left = periods(spark, sf_dir).select(
        KEY, "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, nanos(START)).alias("from_ns"),
        nanos(END).alias("to_ns"),
    )
    right = shipments(spark, sf_dir).select(
        KEY, "shipment", nanos("ship_from").alias("ship_from_ns"),
        F.when(F.col("part") % 2 == 0, nanos("ship_to")).alias("ship_to_ns"),
    )
    return common_interval_join(
        [(left, "from_ns", "to_ns"), (right, "ship_from_ns", "ship_to_ns")], [KEY], hot_rows=50
    )


_OVERLAP_LEFT = f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL}
SELECT p.o_custkey, p.o_orderkey, p.valid_from, p.valid_to, s.shipment, s.ship_from, s.ship_to
FROM periods p LEFT JOIN shipments s ON p.o_custkey = s.o_custkey
 AND p.valid_from < coalesce(s.ship_to, {FAR}) AND s.ship_from < coalesce(p.valid_to, {FAR})"""


def _overlap_left(spark, sf_dir, **options):
    return interval_overlap_join(
        periods(spark, sf_dir).select(KEY, "o_orderkey", START, END),
        shipments(spark, sf_dir).drop("o_orderstatus", "part"),
        [KEY], START, END, "ship_from", "ship_to", "left", **options,
    )


@QUERIES.query(_OVERLAP_LEFT)
def overlap_join_left(spark, sf_dir):
    return _overlap_left(spark, sf_dir)


@QUERIES.query(_OVERLAP_LEFT)
def overlap_join_left_sliced(spark, sf_dir):
    """Same rows with the busier customers found by their later start."""
    return _overlap_left(spark, sf_dir, hot_rows=50)


_POINT = f"""WITH {PERIODS_SQL}, {SHIPMENTS_SQL}
SELECT s.o_custkey, s.shipment, s.ship_from, p.o_orderkey, p.valid_from, p.valid_to
FROM shipments s LEFT JOIN periods p ON p.o_custkey = s.o_custkey
 AND coalesce(p.valid_from, TIMESTAMP '1900-01-01') <= s.ship_from
 AND s.ship_from < coalesce(p.valid_to, {FAR})"""


def _point(spark, sf_dir, **options):
    return point_in_interval_join(
        shipments(spark, sf_dir).select(KEY, "shipment", "ship_from"),
        periods(spark, sf_dir).select(KEY, "o_orderkey", START, END),
        [KEY], "ship_from", START, END, "1900-01-01", "left", **options,
    )


@QUERIES.query(_POINT)
def point_in_interval(spark, sf_dir):
    """Orders that were valid on each shipping day."""
    return _point(spark, sf_dir)


@QUERIES.query(_POINT)
def point_in_interval_sliced(spark, sf_dir):
    return _point(spark, sf_dir, hot_rows=50)


@QUERIES.query(f"""WITH {PERIODS_SQL}, {_TERMS_SQL}, joined AS (
  SELECT p.o_custkey, p.o_orderkey, p.valid_from, t.term_from,
         greatest(p.valid_from, t.term_from) AS lower_end,
         row_number() OVER (PARTITION BY p.o_custkey
                            ORDER BY greatest(p.valid_from, t.term_from), p.o_orderkey) AS nth
  FROM periods p JOIN terms t ON p.o_custkey = t.o_custkey)
SELECT o_custkey, o_orderkey, valid_from, term_from - to_days(30) AS account_from,
       CASE WHEN nth = 1 THEN term_from - to_days(30) ELSE lower_end END AS interval_start
FROM joined""")
def extend_first_interval(spark, sf_dir):
    """The first order of a customer is pulled back to the account's opening."""
    joined = periods(spark, sf_dir).select(KEY, "o_orderkey", START).join(
        _customer_terms(spark, sf_dir).drop("term_to"), KEY
    )
    opened = joined.withColumn(
        "account_from", F.col("term_from") - F.make_dt_interval(F.lit(30))
    )
    return extend_back(
        opened, [START, "term_from"], KEY, "account_from", "interval_start", ["o_orderkey"]
    ).drop("term_from")


@QUERIES.query("""SELECT o_custkey, o_orderkey, row_number() OVER
 (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth_order FROM orders""")
def nth_order(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return running_ordinal(orders, [KEY], ["o_orderdate", "o_orderkey"], "nth_order").select(
        KEY, "o_orderkey", "nth_order"
    )


@QUERIES.query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER
 (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)
 AS nth_item FROM lineitem""")
def nth_item_hot_keys(spark, sf_dir):
    """Three keys hold all line items; numbers are built from slices."""
    items = load(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    numbered = running_ordinal(items, ["l_returnflag"], order, "nth_item", hot_rows=2000)
    return numbered.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "nth_item")


@QUERIES.query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER
 (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth_item FROM lineitem""")
def nth_item_tied(spark, sf_dir):
    """All items on one day: slices are cut by the columns behind it."""
    items = load(spark, sf_dir, "lineitem").withColumn("day", F.lit("2024-01-01").cast("date"))
    order = ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    numbered = running_ordinal(items, ["l_returnflag"], order, "nth_item", hot_rows=2000)
    return numbered.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "nth_item")


@QUERIES.query("""SELECT o_orderpriority, o_orderkey, row_number() OVER
 (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS nth FROM orders""")
def nth_order_by_text(spark, sf_dir):
    """Dates held as text order rows as well as any other type."""
    orders = load(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return running_ordinal(orders, ["o_orderpriority"], ["day", "o_orderkey"], "nth").select(
        "o_orderpriority", "o_orderkey", "nth"
    )


@QUERIES.query("""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F'
                     AND o_orderdate < TIMESTAMP '1999-01-01')""")
def incremental_append(spark, sf_dir):
    """Rows an incremental run appends to a table that ends in 1998."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"
    )
    target = orders.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    return newer_than(orders, target, ["o_orderdate"], "o_orderdate").drop("o_orderstatus")
