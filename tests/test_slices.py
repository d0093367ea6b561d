"""Cuts of hot keys: even slices whatever the type, exact bounds on both paths, and the plans they give."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from spanmart.operators.flatten import flatten_sequential_rows
from spanmart.operators.hotkeys import find_hot_keys, place_of
from spanmart.operators.interval_joins import (
    common_interval_join,
    interval_overlap_join,
    point_in_interval_join,
    stab_join,
)
from spanmart.operators import intervals
from spanmart.operators.intervals import sequentialize_table
from spanmart.operators.ordinals import running_ordinal, tie_break


def sizes(df, cuts, *order, place=None):
    found = cuts.placed(cuts.on(df), "s", *order, place=place).groupBy("k", "s").count()
    return [r["count"] for r in found.collect()]


def test_one_day_is_cut_evenly(spark):
    """All rows of a key on one date, told apart by a later column only, or by nothing but the row."""
    df = spark.range(20_000).select(
        F.lit(1).alias("k"), F.lit(date(2024, 1, 1)).alias("day"), F.col("id").alias("n"), F.lit("x").alias("v")
    )
    hot = find_hot_keys([df], ["k"], 4_000)
    for order in (["day", "n"], ["day"]):
        columns = [*[F.col(c) for c in order], tie_break(df)]
        place = place_of(df, "day")
        found = sizes(df, hot.cuts(df, *columns, place=place), *columns, place=place)
        assert sum(found) == 20_000 and len(found) >= 16
        assert max(found) < 2 * 1_000
    numbered = running_ordinal(df, ["k"], ["day", "n"], "nth", hot_rows=4_000)
    assert numbered.filter(F.col("nth") != F.col("n") + 1).count() == 0
    tied = running_ordinal(df, ["k"], ["day"], "nth", hot_rows=4_000).agg(
        F.count_distinct("nth"), F.min("nth"), F.max("nth")
    )
    assert tuple(tied.first()) == (20_000, 1, 20_000)


def test_text_and_sentinels_are_cut_evenly(spark):
    df = spark.range(8_000).select(
        F.lit("a").alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("name"),
        F.when(F.col("id") == 0, F.lit("9999-12-31 00:00:00").cast("timestamp"))
        .otherwise(F.timestamp_seconds(F.col("id")))
        .alias("at"),
    )
    hot = find_hot_keys([df], ["k"], 1_000)
    for column in ("name", "at"):
        place = place_of(df, column)
        found = sizes(df, hot.cuts(df, F.col(column), place=place), F.col(column), place=place)
        assert len(found) >= 24 and max(found) < 2 * 250


def test_slices_grow_with_the_order_and_nulls_come_first(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), rng.choice(["a", None, "b"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k int, x int, y string")
    hot = find_hot_keys([df], ["k"], 50)
    order = [F.col("x"), F.col("y")]
    place = place_of(df, "x")
    cuts = hot.cuts(df, *order, place=place)
    slices = lambda c: c.placed(c.on(df), "s", *order, place=place).select("k", "x", "y", "s").collect()
    placed = slices(cuts)
    assert placed == slices(cuts.by_value())
    assert len(placed) == 900
    low = lambda v: (v is not None, v if v is not None else 0)
    for key in (1, 2, None):
        mine = sorted((r for r in placed if r["k"] == key), key=lambda r: (low(r["x"]), (r["y"] is not None, r["y"] or "")))
        assert [r["s"] for r in mine] == sorted(r["s"] for r in mine)
        assert len({r["s"] for r in mine}) > 5


@pytest.mark.parametrize("max_cuts", [2, 5, 1 << 14])
def test_bins_change_no_rows(spark, max_cuts):
    """With few cuts, slices are divided into bins of equal width; results stay."""
    rng = random.Random(max_cuts)
    rows = []
    for n in range(1_500):
        start = rng.choice([rng.randint(0, 5_000), 100])
        end = rng.choice([None, start + 1, start + rng.randint(1, 4_000), start - 3])
        rows.append((rng.randint(1, 2), start, end, n))
    df = spark.createDataFrame(rows, "k int, s bigint, e bigint, r int")
    far = F.lit(1 << 40)
    valid = df.filter(F.col("s") < F.coalesce("e", far)).select(
        "k", F.col("s").alias("__start"), F.col("e").alias("__end"),
        F.struct("r").alias("__values"), F.col("r").alias("__order"),
    )
    choice = intervals._Choice(["k"], "s", "e", ["r"], "f")
    hot = find_hot_keys([valid], ["k"], 20)
    by_cell = choice.finish(intervals._pick_by_cell(hot, valid, choice, far, max_cuts))
    plain = choice.finish(intervals._pick_by_key(valid, choice, far))
    assert rows_of(by_cell) == rows_of(plain)

    points = spark.createDataFrame([(rng.randint(1, 2), rng.randint(-5, 6_000), n) for n in range(300)], "k int, p bigint, n int")
    cuts = hot.cuts(points, F.col("p"), rows=10, place=place_of(points, "p"), max_cuts=max_cuts)
    assert (cuts.bins > 1) == (max_cuts < 1000)
    joined = stab_join(points, "p", [(df, F.col("s"), F.col("e"), False, "left")], ["k"], cuts)
    other = df.withColumnRenamed("k", "ok")
    plain = points.join(
        other,
        (F.col("k") == F.col("ok")) & (F.col("s") <= F.col("p")) & (F.col("e").isNull() | (F.col("p") < F.col("e"))),
        "left",
    ).drop("ok")
    assert rows_of(joined) == rows_of(plain)


BASE = {
    "int": lambda n: n,
    "bigint": lambda n: (1 << 62) + n,
    "double": lambda n: float(n) * 1e300 / 50 if n % 7 else float("inf"),
    "decimal(38,4)": lambda n: Decimal(10) ** 20 + Decimal(n) / 8,
    "date": lambda n: date(2024, 1, 1) + timedelta(days=n),
    "timestamp": lambda n: datetime(2024, 1, 1) + timedelta(microseconds=n),
    "string": lambda n: f"{n:04d}",
}


@pytest.mark.parametrize("kind", BASE)
def test_open_ends_are_exact_on_both_paths(spark, kind):
    """Three tables with NULL bounds; no bound ever stands in for an open one."""
    rng = random.Random(len(kind))
    value = BASE[kind]
    tables = []
    for name in "abc":
        rows = []
        for n in range(30):
            start, long = rng.randint(0, 40), rng.randint(-1, 15)
            rows.append((
                rng.randint(1, 2), n,
                None if rng.random() < 0.25 else value(start),
                None if rng.random() < 0.25 else value(start + long),
            ))
        df = spark.createDataFrame(rows, f"k int, {name} int, {name}s {kind}, {name}e {kind}")
        tables.append((df, f"{name}s", f"{name}e"))
    plain = rows_of(common_interval_join(tables, ["k"], hot_rows=None))
    assert len(plain) > 100
    for hot_rows in (2, 40):
        assert rows_of(common_interval_join(tables, ["k"], hot_rows=hot_rows)) == plain


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_keep_rows_without_a_partner(spark, how):
    rng = random.Random(6)

    def some(n, keys):
        out = []
        for i in range(n):
            s = rng.choice([None, rng.randint(0, 60)])
            e = rng.choice([None, (s or 0) + rng.randint(-2, 9)])
            out.append((rng.choice(keys), i, s, e))
        return out

    left = spark.createDataFrame(some(150, [1, 2, 3, None]), "k int, l int, ls int, le int")
    right = spark.createDataFrame(some(90, [1, 2, None]), "k int, r int, rs int, re int")
    run = lambda hot: interval_overlap_join(
        left, right, ["k"], "ls", "le", "rs", "re", how, far_future=50, hot_rows=hot
    )
    assert rows_of(run(3)) == rows_of(run(None))
    stab = lambda hot: point_in_interval_join(
        left, right, ["k"], "ls", "rs", "re", 5, how, far_future=50, hot_rows=hot
    )
    assert rows_of(stab(3)) == rows_of(stab(None))


def test_a_far_sentinel_changes_nothing_but_the_balance(spark):
    rows = [(1, f"v{n % 3}", datetime(2024, 1, 1) + timedelta(hours=n), datetime(9999, 12, 31), n) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, v string, s timestamp, e timestamp, r int")
    run = lambda hot: rows_of(
        sequentialize_table(df, ["k"], "s", "e", ["r"], flag_overlaps_column="f", hot_rows=hot, far_future="9999-12-31 01:00:00")
    )
    assert run(20) == run(None)
    flat = lambda hot: rows_of(flatten_sequential_rows(df.drop("r"), ["k"], "s", "e", ["v"], hot_rows=hot))
    assert flat(20) == flat(None)


def test_sequentialize_hot_aggregates_without_sorting(spark):
    rows = [(n % 2, n, n, n + 50, n * 3) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, v long, s int, e int, o long")
    for hot in (5, None):
        out = sequentialize_table(df, ["k"], "s", "e", ["o"], flag_overlaps_column="f", far_future=900, hot_rows=hot)
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_runs_of_cells_share_halves(spark):
    """Runs of cells are combined by halves, of which there are a few per cell, not by the nodes of every run."""
    n = 60
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    runs = spark.createDataFrame(pairs, "__lo long, __hi long").filter("__lo > 0").withColumn("m", intervals._middle())
    found = runs.collect()
    assert all(r["__lo"] <= r["m"] <= r["__hi"] for r in found)
    halves = {(r["__lo"], r["m"]) for r in found} | {(r["m"], r["__hi"]) for r in found}
    assert len(halves) <= 2 * n * n.bit_length() < len(found)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_hot_paths_plan_few_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def table(name):
            rows = [(n % 2, n, n, n + 5) for n in range(200)]
            return spark.createDataFrame(rows, f"k int, {name} int, {name}s int, {name}e int")

        tables = [(table(n), f"{n}s", f"{n}e") for n in "abc"]
        assert exchanges(common_interval_join(tables, ["k"], hot_rows=5)) <= 15
        left, right = tables[0][0], tables[1][0]
        point = point_in_interval_join(left, right, ["k"], "as", "bs", "be", 0, "left", far_future=900, hot_rows=5)
        assert exchanges(point) <= 4
        flagged = sequentialize_table(left, ["k"], "as", "ae", ["a"], far_future=900, hot_rows=5)
        assert exchanges(flagged) <= 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rows(spark):
    empty = [spark.createDataFrame([], f"k int, {n} int, {n}s int, {n}e int") for n in "ab"]
    joined = common_interval_join([(empty[0], "as", "ae"), (empty[1], "bs", "be")], ["k"], hot_rows=1)
    assert joined.collect() == []
    assert reduce(lambda a, b: a and b, [running_ordinal(e, ["k"], [e.columns[1]], "n", hot_rows=1).collect() == [] for e in empty])


def test_plans_do_not_grow_with_the_number_of_hot_keys(spark):
    """Keys that fit one slice are not cut, however many are hot; a larger one among them is, and rows stay."""

    def joined(keys, hot_rows, large=0):
        tables = []
        for name in "ab":
            rows = spark.range(keys * 10 + large).select(
                F.when(F.col("id") < keys * 10, F.col("id") % keys).otherwise(-1).alias("k"),
                F.col("id").alias(name), (F.col("id") * 7 % 31).alias(f"{name}s"), (F.col("id") * 7 % 31 + 3).alias(f"{name}e"),
            )
            tables.append((rows, f"{name}s", f"{name}e"))
        return common_interval_join(tables, ["k"], hot_rows=hot_rows)

    length = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert length(joined(2_000, 8)) < 1.5 * length(joined(20, 8))
    assert rows_of(joined(12, 8, 200)) == rows_of(joined(12, None, 200))


def test_items_meet_orders_without_a_broadcast(spark, tmp_path):
    """Two columns of a compressed file look small, all their rows need not be."""
    from registered.common import shipments

    orders = spark.range(3).selectExpr("id o_orderkey", "id % 2 o_custkey")
    items = spark.range(3).selectExpr(
        "id l_orderkey", "1 l_linenumber", "id l_partkey", "'R' l_returnflag", "timestamp_ntz'2024-01-01' l_shipdate", "2d l_quantity"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = shipments(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found, "o_custkey", "shipment") == [(0, 1), (0, 21), (1, 11)]
