"""Column functions and small operators on known rows."""

from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmart.functions import dates, keys, predicates, text
from spanmart.operators import columns, dedupe, metrics, pii, quality, unions


def one(spark, expr, **cols):
    """Value of an expression over one row of named literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("_")])
    return row.select(expr.alias("x")).first()["x"]


def ts(spark_text):
    return F.lit(spark_text).cast("timestamp")


def test_zones(spark):
    instant = ts("2020-07-01 23:30:00")
    assert one(spark, dates.localize(instant, "Europe/London")) == datetime(2020, 7, 2, 0, 30)
    assert one(spark, dates.to_local_date(instant, tz="Europe/London")) == date(2020, 7, 2)
    assert one(spark, dates.to_local_date(instant, localized=False)) == date(2020, 7, 1)
    assert one(spark, dates.local_midnight_timestamp(instant, "Europe/London")) == datetime(
        2020, 7, 1, 23
    )
    assert one(spark, dates.timestamp_to_utc(instant)) == datetime(2020, 7, 1, 23, 30)


def test_clocks_going_back_share_a_wall_time(spark):
    for hour in ("00", "01"):
        instant = ts(f"2020-10-25 {hour}:30:00")
        assert one(spark, dates.localize(instant, "Europe/London")) == datetime(2020, 10, 25, 1, 30)


def test_now(spark):
    now = datetime.now(UTC).replace(tzinfo=None)
    assert abs(one(spark, dates.current_timestamp_utc()) - now) < timedelta(minutes=5)
    tokyo = one(spark, dates.current_timestamp_local("Asia/Tokyo"))
    assert abs(tokyo - now - timedelta(hours=9)) < timedelta(minutes=5)
    assert one(spark, dates.current_date_local("Asia/Tokyo")) in (
        tokyo.date(), tokyo.date() + timedelta(days=1)
    )


@pytest.mark.parametrize(
    "given, expected",
    [("2024-01-10", "2024-01-31"), ("2024-02-03", "2024-02-15"), ("2024-03-01", "2024-02-15"),
     ("2024-01-31", "2024-01-31")],
)
def test_report_date(spark, given, expected):
    out = dates.to_report_date(F.lit(given).cast("date"), now=ts("2024-02-15 12:00:00"))
    assert str(one(spark, out)) == expected


def test_regional_timezones(spark):
    df = spark.range(1).select(ts("2020-01-01 12:00:00").alias("at"))
    row = dates.regional_timezones(df, "at").first()
    hours = {c[3:-3]: row[c].hour for c in row.asDict() if c != "at"}
    assert hours == {
        "london": 12, "paris": 13, "berlin": 13, "tokyo": 21, "wellington": 1, "texas": 6, "madrid": 13
    }


def test_spines(spark):
    days = dates.date_spine(spark, "day", "2020-01-30", "2020-02-02")
    assert days.columns == ["date_day"] and days.count() == 4
    hours = dates.date_spine(spark, "HOUR", "2020-01-01", "2020-01-02", granularity=6)
    assert hours.columns == ["date_hour"] and hours.count() == 5
    table = dates.build_date_spine(spark, "2020-01-03", "2020-01-06")
    assert rows_of(table) == [
        (date(2020, 1, 3), "Fri", False), (date(2020, 1, 4), "Sat", True), (date(2020, 1, 5), "Sun", True)
    ]
    whole = dates.build_date_spine(spark, "2098-12-30")
    assert whole.agg(F.max("date_day")).first()[0] == date(2098, 12, 31)
    with pytest.raises(ValueError):
        dates.date_spine(spark, "day; drop", "2020-01-01", "2020-01-02")


def test_ms_int_to_time(spark):
    ms = (11 * 3600 + 22 * 60 + 33) * 1000 + 456
    out = one(spark, dates.ms_int_to_time("ms"), ms=ms - 1462009856)
    assert out == timedelta(hours=11, minutes=22, seconds=33)
    assert one(spark, dates.ms_int_to_time("ms", reference_ms=0), ms=ms) == out


def test_split_str_time_range(spark):
    closed = '["2020-01-01 00:00:00+00","2020-02-01 00:00:00+00")'
    opened = '["2020-01-01 00:00:00+00",)'
    assert one(spark, dates.split_str_time_range("r"), r=closed) == datetime(2020, 1, 1)
    assert one(spark, dates.split_str_time_range("r", False), r=closed) == datetime(2020, 2, 1)
    assert one(spark, dates.split_str_time_range("r", False), r=opened) == datetime(
        2099, 12, 31, 23, 59, 59
    )
    assert one(spark, dates.split_str_time_range("r"), r="nothing") is None


def test_run_id_timestamp(spark):
    assert one(spark, dates.run_id_timestamp("c"), c="manual__2024-01-01T05:06:07+00:00") == datetime(
        2024, 1, 1, 5, 6, 7
    )
    for bad in ("manual", "manual__soon"):
        assert one(spark, dates.run_id_timestamp("c"), c=bad) is None


def test_text(spark):
    assert one(spark, text.string_to_array("c"), c='["A","B"]') == ["A", "B"]
    assert one(spark, text.string_to_array("c"), c="[]") == []
    # The trim arguments are character sets.
    assert one(spark, text.string_to_array("c"), c='[["A","B"]]') == ["A", "B"]
    assert one(spark, text.string_to_array("c", "(", ")", ";", "()"), c="(x;y)") == ["x", "y"]
    df = spark.createDataFrame([("",), ("a",)], "c string")
    assert df.select(text.nullify_empty_strings("c")).columns == ["c"]
    assert rows_of(df.select(text.nullify_empty_strings("c", "d"))) == [(None,), ("a",)]
    assert one(spark, text.cents_to_dollars("c"), c=1205) == Decimal("12.05")
    assert one(spark, text.cents_to_dollars("c"), c=1205.5) == Decimal("12.06")
    assert one(spark, text.json_map_key("c", "K"), c='{"K": {"n": 1}}') == '{"n":1}'
    assert one(spark, text.json_map_key("c", "K"), c="{broken") is None
    assert one(spark, text.safe_cast("c", "int"), c="x") is None


def test_keys(spark):
    import hashlib

    got = one(spark, keys.surrogate_key("a", "b"), a=1, b=None)
    assert got == hashlib.md5(b"1-_dbt_utils_surrogate_key_null_").hexdigest()
    assert one(spark, keys.composite_key("a", "b"), a="x", b="y") == "x.y"
    assert one(spark, keys.composite_key("a", "b"), a="x", b=None) is None
    want = hashlib.sha256(b"g||u||true").hexdigest()
    assert one(spark, keys.membership_id("g", "u", "d"), g="g", u="u", d=True) == want
    skipped = hashlib.sha256(b"g||u").hexdigest()
    assert one(spark, keys.membership_id("g", "u", F.lit(None).cast("boolean")), g="g", u="u") == skipped
    assert one(spark, keys.flag(F.col("a") == "x"), a=None) is False
    assert one(spark, keys.label(F.lit(None).cast("boolean"), "t", "f")) == "f"
    ids = spark.range(100, numPartitions=7).select(keys.row_id().alias("i"))
    assert ids.distinct().count() == 100


def test_predicates(spark):
    day = ts("2020-01-05")
    low, high = ts("2020-01-01"), ts("2020-01-05")
    start = ts("1990-01-01")
    none = F.lit(None).cast("timestamp")
    assert one(spark, predicates.date_between(day, low, none, start)) is True
    assert one(spark, predicates.date_between(day, low, high, start)) is False
    assert one(spark, predicates.date_between(low, low, high, start)) is True
    assert one(spark, predicates.date_between(day, none, none, day)) is True
    cols = dict(a=1, b=4, c=3, d=9)
    assert one(spark, predicates.intervals_overlap(["a", "c"], ["b", "d"]), **cols) is True
    assert one(spark, predicates.intervals_overlap(["b", "d"], ["b", "d"]), **cols) is False
    assert one(spark, predicates.merged_interval_below(["a", "c"]), **cols) == 3
    assert one(spark, predicates.merged_interval_above(["b", "d"]), **cols) == 4
    df = spark.createDataFrame([(1, 5, 2), (1, 7, 2), (2, 9, 3)], "id int, s int, p int")
    out = df.select("id", predicates.merged_interval_below(["s"], True, "id", "p").alias("x"))
    assert rows_of(out) == [(1, 2), (1, 7), (2, 3)]
    with pytest.raises(ValueError):
        predicates.merged_interval_below(["s"], extend_back=True)


def test_distinct_on(spark):
    df = spark.createDataFrame(
        [(1, 1, 1), (1, None, 5), (2, 7, 3)], "k int, v int, t int"
    )
    assert rows_of(dedupe.distinct_on(df, ["k"], ["t"], ["v"])) == [(1, None, 5), (2, 7, 3)]
    assert rows_of(dedupe.distinct_on(df, ["k"], ["t"], ["v"], "MIN")) == [(1, 1, 1), (2, 7, 3)]
    filled = dedupe.distinct_on(df, ["k"], ["t"], ["v"], skip_nulls=True)
    assert rows_of(filled) == [(1, 1, 5), (2, 7, 3)]
    assert rows_of(dedupe.distinct_on(df, ["k"], ["t"], [])) == [(1, 5), (2, 3)]
    pair = spark.createDataFrame([(1, "a", None), (1, "b", 2)], "k int, v string, t int")
    assert rows_of(dedupe.distinct_on(pair, ["k"], ["t", "v"], ["v"], "MIN"), "v") == [("a",)]
    assert rows_of(dedupe.distinct_on(pair, ["k"], ["t"], ["v"], "MIN"), "v") == [("b",)]
    with pytest.raises(ValueError):
        dedupe.distinct_on(df, ["k"], ["t"], ["v"], "LAST")


def test_keep_latest_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-02", 1), ("a", "2024-01-10", 2), ("b", "2023-05-05", 3)],
        "unique_id string, generated_at string, n int",
    )
    latest = dedupe.keep_latest(df)
    assert latest.columns == df.columns and rows_of(latest, "n") == [(2,), (3,)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_unions(spark):
    a = spark.createDataFrame([(1, "Alice")], "id int, name string")
    b = spark.createDataFrame([("Bob", 2, True)], "name string, id int, extra boolean")
    cols = ["id", "name"]
    assert rows_of(unions.union_columns(a, b, cols)) == [(1, "Alice"), (2, "Bob")]
    assert rows_of(unions.union_columns(a, a, cols, "DISTINCT")) == [(1, "Alice")]
    assert unions.union_columns(a, a, cols, "all").count() == 2
    for bad in (lambda: unions.union_columns(a, b, cols, "ANY"),
                lambda: unions.union_columns(a, b, ["id", "extra"]),
                lambda: unions.union_columns(a, b, [])):
        with pytest.raises(ValueError):
            bad()
    assert unions.union_territories([a, a, a], a.schema).count() == 3
    with pytest.raises(ValueError, match="contract"):
        unions.union_territories([a, b], a.schema)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "ID int, b int")
    assert columns.rename_columns(df, {"b": "y", "id": "x"}).columns == ["y", "x"]
    assert columns.star_except(df, ["b"]).columns == ["ID"]
    with pytest.raises(ValueError):
        columns.star_except(df, ["ID", "b"])
    with pytest.raises(ValueError):
        columns.rename_columns(df, {"c": "x"})


def test_pii(spark, tmp_path, monkeypatch):
    import hashlib

    df = pii.tag_columns(
        spark.createDataFrame([(1, " Ann", "x"), (2, None, "y")], "id int, Name string, v string"),
        ["Name"],
    )
    path = str(tmp_path / "tagged")
    df.write.parquet(path)
    back = spark.read.parquet(path).filter("id > 0").select("id", "Name", "v")
    assert pii.columns_with_meta(back, "sensitive") == ["Name"]
    assert pii.columns_with_meta(back) == ["Name"]
    hashed = pii.hash_sensitive_columns(back, salt="S1 ")
    assert hashed.columns == ["name_hash", "id", "v"]
    want = hashlib.sha256(b"anns1").hexdigest()
    assert rows_of(hashed, "id", "name_hash") == [(1, want), (2, None)]
    clear = pii.nohash_sensitive_columns(back, "id", salt="s")
    assert clear.columns == ["id_hash", "Name"]
    assert pii.nohash_sensitive_columns(back).columns == ["Name"]
    monkeypatch.delenv("PII_SALT", raising=False)
    with pytest.raises(ValueError):
        pii.hash_column("id")
    monkeypatch.setenv("PII_SALT", "s")
    assert rows_of(back.select(pii.hash_column("id"))) == rows_of(
        back.select(pii.hash_column("id", "s"))
    )


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, "a", 5), (1, "b", None), (None, "c", 7), (None, None, 1)], "k int, v string, n int"
    )
    assert quality.check_not_null(df, "k").count() == 2
    assert rows_of(quality.check_unique(df, "k")) == [(1, 2)]
    assert rows_of(quality.check_accepted_values(df, "v", ["a", "b"])) == [("c", 1)]
    parent = spark.createDataFrame([(2,)], "id int")
    assert quality.check_relationship(df, "k", parent, "id").count() == 2
    assert rows_of(quality.check_expression(df, "n > 4"), "n") == [(1,)]
    assert rows_of(quality.check_expression(df, F.col("n") > 4), "n") == [(1,)]
    assert quality.check_contract(df, df.schema).count() == 0
    wanted = T.StructType([T.StructField("k", T.StringType()), T.StructField("z", T.LongType())])
    found = quality.check_contract(df, wanted)
    assert rows_of(found, "column_name", "problem") == [
        ("k", "type"), ("n", "unexpected"), ("v", "unexpected"), ("z", "missing")
    ]
    assert rows_of(quality.source_freshness(df, "n", "src")) == [("src", 7)]


def test_metrics(spark):
    now = ts("2024-01-10 00:00:00")
    df = spark.createDataFrame(
        [("2024-01-09 05:10:00", 60.0), ("2024-01-09 05:50:00", 30.0), ("2024-01-09 06:00:00", 6.0),
         ("2024-01-01 00:00:00", 99.0), ("2024-01-11 00:00:00", 99.0)],
        "at string, sec double",
    ).withColumn("at", F.col("at").cast("timestamp"))
    out = metrics.metric_query(
        df,
        [metrics.time_dimension("at", "HOUR")],
        [metrics.metric("minutes", "sum", "sec / 60"), metrics.metric("top", "max", "sec")],
        filters=[metrics.in_the_past("at", 7, now)],
        sorts=[("at_hour", True)],
        limit=2,
    )
    assert [tuple(r) for r in out.collect()] == [
        (datetime(2024, 1, 9, 6), 0.1, 6.0), (datetime(2024, 1, 9, 5), 1.5, 60.0)
    ]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    assert metrics.top_n(df, "sec", 1).count() == 1
    for bad in (lambda: metrics.metric("x", "avg", "sec"), lambda: metrics.time_dimension("at", "MINUTE"),
                lambda: metrics.metric_query(df, [], [])):
        with pytest.raises(ValueError):
            bad()


def test_partitions_follow_the_shuffle_size():
    from spanmart.session import partitions_for

    assert partitions_for(1) == 200
    assert partitions_for(100 * 10**12) == 745_059


def test_spines_are_made_in_parts(spark):
    minutes = dates.date_spine(spark, "minute", "1970-01-01", "2099-12-31")
    assert minutes.count() == 4_102_358_400 // 60 + 1
    months = dates.date_spine(spark, "month", "2020-01-31", "2020-04-30")
    assert [str(r[0])[:10] for r in months.orderBy("date_month").collect()] == ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"]
    assert dates.date_spine(spark, "day", "2020-01-02", "2020-01-01").count() == 0


def test_no_limit_unless_asked_for(spark):
    df = spark.range(1000).withColumn("v", F.col("id"))
    out = metrics.metric_query(df, ["id"], [metrics.metric("s", "sum", "v")], sorts=[("s", True)])
    assert out.count() == 1000


def test_a_null_in_the_list_accepts_nothing_else(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in quality.check_accepted_values(df, "v", ["a", None]).collect()] == [("b", 1)]
