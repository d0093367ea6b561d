"""Interval operators: known rows, edge rows and brute-force properties.

Every case runs on the plain path and on the sliced path for hot keys.
"""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from spanmart.operators.flatten import (
    flatten_sequential_rows,
    flatten_sequential_rows_mixed_datatypes,
    flatten_sequential_rows_no_value_cols,
)
from spanmart.operators.interval_joins import (
    common_interval_join,
    extend_back,
    interval_overlap_join,
    point_in_interval_join,
)
from spanmart.operators.intervals import (
    get_overlap_detail,
    merge_sequential_intervals,
    sequentialize_table,
)
from spanmart.operators.ordinals import running_ordinal

# 1000: keys are counted, none is hot; 1: keys with two rows or more are hot.
PATHS = [1000, 1]


def day(n):
    return None if n is None else datetime(2020, 1, 1) + timedelta(days=n - 1)


def table(spark, rows, cols="k int, v string, s timestamp, e timestamp, r int"):
    return spark.createDataFrame([(k, v, day(s), day(e), r) for k, v, s, e, r in rows], cols)


def spans(df, *cols):
    return rows_of(df, *cols)


@pytest.fixture(params=PATHS)
def hot(request):
    return request.param


# ---------------------------------------------------------------- sequentialize


@pytest.mark.parametrize(
    "rows, expected",
    [
        (
            [(1, "A", 1, 10, 1), (1, "B", 5, 15, 2)],
            [(1, "A", 1, 5, False), (1, "B", 5, 10, True), (1, "B", 10, 15, False)],
        ),
        (
            [(1, "A", 1, None, 1), (1, "B", 5, 8, 2)],
            [(1, "A", 1, 5, False), (1, "B", 5, 8, True), (1, "A", 8, None, False)],
        ),
        ([(1, "A", 1, 5, 1), (1, "A", 8, 10, 2)], [(1, "A", 1, 5, False), (1, "A", 8, 10, False)]),
        ([(1, "A", 3, 3, 1), (1, "B", 9, 4, 1)], []),
        ([(None, "A", 1, 5, 1), (None, "B", 2, 5, 1)], []),
        (
            [(1, "A", 1, 5, 1), (1, "B", 1, 5, 2), (1, "C", 1, 5, 0)],
            [(1, "B", 1, 5, True)],
        ),
    ],
)
def test_sequentialize_known_rows(spark, hot, rows, expected):
    out = sequentialize_table(
        table(spark, rows), ["k"], "s", "e", ["r"], flag_overlaps_column="f", hot_rows=hot
    )
    assert out.columns == ["k", "s", "e", "v", "r", "f"]
    want = sorted([(k, v, day(s), day(e), f) for k, v, s, e, f in expected], key=str)
    assert sorted(rows_of(out, "k", "v", "s", "e", "f"), key=str) == want


def _random_rows(seed, keys=3, n=60, span=40, open_share=0.1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randint(1, span)
        e = None if rng.random() < open_share else s + rng.randint(-1, 15)
        rows.append((rng.randint(1, keys), rng.choice("ABC"), s, e, i))
    return rows


def _brute_sequentialize(rows):
    far = 10_000
    out = []
    valid = [r for r in rows if r[2] < (far if r[3] is None else r[3])]
    for key in {r[0] for r in valid}:
        mine = [r for r in valid if r[0] == key]
        bounds = {r[2] for r in mine} | {r[3] for r in mine}
        ordered = sorted(b for b in bounds if b is not None) + ([None] if None in bounds else [])
        for a, b in zip(ordered, ordered[1:], strict=False):
            cover = [r for r in mine if r[2] <= a < (far if r[3] is None else r[3])]
            if cover:
                best = max(cover, key=lambda r: r[4])
                out.append((key, best[1], day(a), day(b), best[4], len(cover) > 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_sequentialize_matches_brute_force(spark, hot, seed):
    rows = _random_rows(seed)
    df = table(spark, rows)
    out = sequentialize_table(
        df, ["k"], "s", "e", ["r"], value_cols=["v", "r"], flag_overlaps_column="f", hot_rows=hot
    )
    assert sorted(rows_of(out, "k", "v", "s", "e", "r", "f"), key=str) == _brute_sequentialize(rows)


def test_sequentialize_wide_rows(spark, hot):
    rows = _random_rows(6)
    df = table(spark, rows).withColumns({f"w{i}": F.concat("v", F.lit(i)) for i in range(4)})
    out = sequentialize_table(
        df, ["k"], "s", "e", ["r"], flag_overlaps_column="f", hot_rows=hot
    )
    assert out.columns == ["k", "s", "e", "v", "r", "w0", "w1", "w2", "w3", "f"]
    assert out.filter("w3 <> concat(v, '3')").count() == 0
    assert sorted(rows_of(out, "k", "v", "s", "e", "r", "f"), key=str) == _brute_sequentialize(rows)
    unordered = sequentialize_table(
        df.withColumn("r", F.lit(None).cast("int")), ["k"], "s", "e", ["r"], hot_rows=hot
    )
    assert unordered.count() == out.count() and unordered.filter("w0 is not null").count() == 0


def test_sequentialize_options(spark, hot):
    df = table(spark, [(1, "A", 1, 10, 1), (1, "B", 5, 15, 2)])
    keys_only = sequentialize_table(df, ["k"], "s", "e", ["r"], value_cols=[], hot_rows=hot)
    assert keys_only.columns == ["k", "s", "e"] and keys_only.count() == 3
    early = sequentialize_table(
        df, ["k"], "s", "e", ["r"], pre_filter=F.col("v") == "A", value_cols=["v"], hot_rows=hot
    )
    assert rows_of(early) == [(1, day(1), day(10), "A")]
    with pytest.raises(ValueError):
        sequentialize_table(df, [], "s", "e", ["r"])
    with pytest.raises(ValueError):
        sequentialize_table(df.select("k", "s", "e"), ["k"], "s", "e", ["s"])


def test_sequentialize_null_order(spark, hot):
    df = table(spark, [(1, "A", 1, 5, None), (1, "B", 1, 5, 3), (2, "C", 1, 5, None)])
    one = sequentialize_table(df, ["k"], "s", "e", ["r"], value_cols=["v"], hot_rows=hot)
    # A lone NULL order selects nothing; a tuple still counts it, as the lowest.
    assert rows_of(one, "k", "v") == [(1, "B"), (2, None)]
    two = sequentialize_table(df, ["k"], "s", "e", ["r", "v"], value_cols=["v"], hot_rows=hot)
    assert rows_of(two, "k", "v") == [(1, "B"), (2, "C")]


def test_sequentialize_far_future_bounds(spark, hot):
    far = datetime(2150, 1, 1)
    later = datetime(2160, 1, 1)
    rows = [(1, "A", day(1), None, 1), (1, "B", far, later, 2), (1, "C", day(3), far, 0)]
    df = spark.createDataFrame(rows, "k int, v string, s timestamp, e timestamp, r int")
    out = sequentialize_table(df, ["k"], "s", "e", ["r"], value_cols=["v"], hot_rows=hot)
    assert rows_of(out, "s", "e", "v") == [
        (day(1), day(3), "A"),
        (day(3), far, "A"),
        (far, later, "B"),
    ]


def test_sequentialize_integer_timeline(spark, hot):
    df = spark.createDataFrame([(1, 1, 10, "A"), (1, 4, 6, "B")], "k int, s int, e int, v string")
    out = sequentialize_table(
        df, ["k"], "s", "e", ["v"], value_cols=["v"], far_future=1_000_000, hot_rows=hot
    )
    assert rows_of(out) == [(1, 1, 4, "A"), (1, 4, 6, "B"), (1, 6, 10, "A")]


# ---------------------------------------------------------------- merge


def _merge_inputs(spark):
    left = spark.createDataFrame(
        [(1, "Business", day(1), day(5)), (1, "Domestic", day(5), day(10))],
        "account_id int, left_val string, valid_from timestamp, valid_to timestamp",
    )
    right = spark.createDataFrame(
        [(1, "Big", day(1), day(5)), (1, "Small", day(5), day(15))],
        "account_id int, right_val string, valid_from timestamp, valid_to timestamp",
    )
    return left, right


@pytest.mark.parametrize("join_type", ["left", "outer"])
def test_merge_known_rows(spark, hot, join_type):
    left, right = _merge_inputs(spark)
    out = merge_sequential_intervals(
        left, right, ["account_id"], "valid_from", "valid_to", ["left_val"],
        "valid_from", "valid_to", ["right_val"], join_type=join_type, hot_rows=hot,
    )
    assert out.columns == ["account_id", "interval_start", "interval_end", "left_val", "right_val"]
    expected = [
        (1, day(1), day(5), "Business", "Big"),
        (1, day(5), day(10), "Domestic", "Small"),
    ]
    if join_type == "outer":
        expected.append((1, day(10), day(15), None, "Small"))
    assert rows_of(out) == expected


@pytest.mark.parametrize("join_type", ["left", "outer"])
@pytest.mark.parametrize("seed", [4])
def test_merge_matches_brute_force(spark, hot, join_type, seed):
    far = 10_000
    lrows, rrows = _random_rows(seed, n=25), _random_rows(seed + 50, n=25)
    out = merge_sequential_intervals(
        table(spark, lrows), table(spark, rrows), ["k"], "s", "e", ["r"], "s", "e", ["r"],
        join_type=join_type, hot_rows=hot,
    )
    want = []
    for key in {r[0] for r in lrows + rrows}:
        mine = [[r for r in rows if r[0] == key] for rows in (lrows, rrows)]
        bounds = sorted({b for rows in mine for r in rows for b in (r[2], r[3]) if b is not None})
        for a, b in zip(bounds, [*bounds[1:], None], strict=True):
            def cover(rows, a=a, b=b):
                return [
                    r for r in rows
                    if r[2] < (far if b is None else b) and (far if r[3] is None else r[3]) > a
                ]
            ls, rs = cover(mine[0]), cover(mine[1])
            if not ls and (join_type == "left" or not rs):
                continue
            for left in ls or [None]:
                for right in rs or [None]:
                    want.append(
                        (key, day(a), day(b), left and left[4], right and right[4])
                    )
    got = rows_of(out, "k", "interval_start", "interval_end", "left_r", "right_r")
    # A row number of zero is falsy, so compare what the brute force stores.
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("join_type", ["left", "outer"])
@pytest.mark.parametrize("seed", [14])
def test_merge_by_sweep_equals_merge_by_join(spark, hot, join_type, seed):
    sides = [
        sequentialize_table(
            table(spark, _random_rows(seed + i, n=25)), ["k"], "s", "e", ["r"], value_cols=["v", "r"]
        ).unionByName(table(spark, [(1, "zero", 7, 7, -1), (2, "back", 9, 5, -1)]))
        for i in (0, 100)
    ]
    args = (*sides, ["k"], "s", "e", ["v", "r"], "s", "e", ["v", "r"])
    swept = merge_sequential_intervals(*args, join_type=join_type, sequential=True, hot_rows=hot)
    joined = merge_sequential_intervals(*args, join_type=join_type, hot_rows=None)
    assert swept.columns == joined.columns
    assert swept.count() > 10
    assert sorted(rows_of(swept), key=str) == sorted(rows_of(joined), key=str)


def test_merge_by_sweep_refuses_overlaps(spark, hot):
    left = table(spark, [(1, "A", 1, 9, 1), (1, "B", 5, 12, 2)])
    right = table(spark, [(1, "C", 1, 2, 3)])
    for sides in ((left, right), (right, left), (left.limit(1).unionAll(left.limit(1)), right)):
        out = merge_sequential_intervals(
            *sides, ["k"], "s", "e", ["v"], "s", "e", ["v"], sequential=True, hot_rows=hot
        )
        with pytest.raises(Exception, match="overlap"):
            out.collect()


def test_merge_common_columns(spark, hot):
    left = table(spark, [(1, "A", 1, 5, 1)])
    right = table(spark, [(1, "B", 1, 5, 2)])
    args = (["k"], "s", "e", ["k", "v", "s"], "s", "e", ["v", "e"])
    both = merge_sequential_intervals(left, right, *args, hot_rows=hot)
    assert both.columns == ["k", "interval_start", "interval_end", "left_v", "right_v"]
    for side, value in (("left", "A"), ("right", "B")):
        one = merge_sequential_intervals(left, right, *args, common=side, hot_rows=hot)
        assert rows_of(one, "v") == [(value,)]
    with pytest.raises(ValueError):
        merge_sequential_intervals(left, right, *args, common="neither")
    with pytest.raises(ValueError):
        merge_sequential_intervals(left, right, *args, join_type="inner")


def test_merge_incremental(spark):
    left, right = _merge_inputs(spark)
    target = spark.createDataFrame([(day(3),)], "mark timestamp")
    out = merge_sequential_intervals(
        left, right, ["account_id"], "valid_from", "valid_to", ["left_val"],
        "valid_from", "valid_to", ["right_val"],
        incremental=(target, ["interval_start"], "mark"),
    )
    assert rows_of(out, "left_val") == [("Domestic",)]
    empty = merge_sequential_intervals(
        left, right, ["account_id"], "valid_from", "valid_to", ["left_val"],
        "valid_from", "valid_to", ["right_val"],
        incremental=(target.limit(0), ["interval_start"], "mark"),
    )
    assert empty.count() == 2


# ---------------------------------------------------------------- overlap detail


@pytest.mark.parametrize("seed", [7])
def test_overlap_detail_matches_brute_force(spark, hot, seed):
    far = 10_000
    rows = _random_rows(seed, n=40)
    out = get_overlap_detail(table(spark, rows), ["k"], "s", "e", ["r"], hot_rows=hot)
    assert out.columns == ["k", "v", "s", "e", "r", "overlap_start", "overlap_end"]
    valid = [r for r in rows if r[2] < (far if r[3] is None else r[3])]
    want = []
    for key in {r[0] for r in valid}:
        mine = [r for r in valid if r[0] == key]
        bounds = {b for r in mine for b in (r[2], r[3])}
        ordered = sorted(b for b in bounds if b is not None) + ([None] if None in bounds else [])
        for a, b in zip(ordered, ordered[1:], strict=False):
            if sum(r[2] <= a < (far if r[3] is None else r[3]) for r in mine) > 1:
                want += [
                    (key, r[4], day(a), day(b))
                    for r in rows
                    if r[0] == key
                    and a < (far if r[3] is None else r[3])
                    and (far if b is None else b) > r[2]
                ]
    got = rows_of(out, "k", "r", "overlap_start", "overlap_end")
    assert sorted(got, key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- flatten


def test_flatten_mixed_known_rows(spark, hot):
    df = spark.createDataFrame(
        [
            (1, "Business", 10, True, day(1), day(5)),
            (1, "Business", 10, True, day(5), day(10)),
            (2, "Big", 16, True, day(1), day(5)),
            (2, "Small", 7, False, day(5), day(15)),
        ],
        "account_id int, string_val string, int_val int, bool_val boolean, "
        "valid_from timestamp, valid_to timestamp",
    )
    expected = [
        (1, "Business", 10, True, day(1), day(10)),
        (2, "Big", 16, True, day(1), day(5)),
        (2, "Small", 7, False, day(5), day(15)),
    ]
    for fn in (flatten_sequential_rows_mixed_datatypes, flatten_sequential_rows):
        out = fn(df, ["account_id"], "valid_from", "valid_to", hot_rows=hot)
        assert out.columns == df.columns
        assert rows_of(out) == expected


def test_flatten_value_in_between(spark, hot):
    df = table(spark, [(1, "A", 1, 5, 0), (1, "B", 3, 4, 0), (1, "A", 5, 9, 0)])
    mixed = flatten_sequential_rows_mixed_datatypes(df, ["k"], "s", "e", ["v"], hot_rows=hot)
    assert rows_of(mixed) == [(1, "A", day(1), day(9)), (1, "B", day(3), day(4))]
    plain = flatten_sequential_rows(df, ["k"], "s", "e", ["v"], hot_rows=hot)
    assert plain.count() == 3


def test_flatten_nulls_and_open_ends(spark, hot):
    nulls = table(spark, [(1, None, 1, 3, 0), (1, None, 3, 5, 0)])
    assert rows_of(flatten_sequential_rows(nulls, ["k"], "s", "e", ["v"], hot_rows=hot)) == [
        (1, None, day(1), day(5))
    ]
    opened = table(spark, [(1, "A", 1, 5, 0), (1, "A", 5, None, 0)])
    for keep, end in ((False, 5), (True, None)):
        out = flatten_sequential_rows(
            opened, ["k"], "s", "e", ["v"], keep_open_end=keep, hot_rows=hot
        )
        assert rows_of(out) == [(1, "A", day(1), day(end))]
    with pytest.raises(ValueError):
        flatten_sequential_rows(opened, ["k"], "s", "e", ["v"], ["r"])


def _brute_flatten(rows, group, compare):
    order = sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[1]))
    last, islands = {}, []
    for r in order:
        g = tuple(r[i] for i in group)
        c = tuple(r[i] for i in compare)
        prev = last.get(g)
        if prev and prev[0] is not None and prev[0] >= r[2] and prev[1] == c:
            island = prev[2]
            island[1] = max((x for x in (island[1], r[3]) if x is not None), default=None)
        else:
            island = [r[2], r[3], g + c]
            islands.append(island)
        last[g] = (r[3], c, island)
    return sorted(((*i[2], day(i[0]), day(i[1])) for i in islands), key=str)


@pytest.mark.parametrize("seed", [11, 12])
def test_flatten_matches_brute_force(spark, hot, seed):
    rows = _random_rows(seed, keys=2, n=50, span=120)
    # Copies, also of open and inverted rows.
    rows += rows[:10] * 2 + [(1, "A", 130, 129, 0), (1, "B", 131, None, 0)] * 3
    df = table(spark, rows)
    args = (["k"], "s", "e")
    plain = flatten_sequential_rows(df, *args, ["v"], hot_rows=hot)
    assert sorted(rows_of(plain), key=str) == _brute_flatten(rows, [0], [1])
    mixed = flatten_sequential_rows_mixed_datatypes(df, *args, ["v"], hot_rows=hot)
    assert sorted(rows_of(mixed), key=str) == _brute_flatten(rows, [0, 1], [])
    cover = flatten_sequential_rows_no_value_cols(df, *args, hot_rows=hot)
    assert sorted(rows_of(cover), key=str) == _brute_flatten(rows, [0], [])


def test_flatten_mixed_twice_changes_nothing(spark):
    """Holds for closed rows that do not overlap."""
    closed = sequentialize_table(
        table(spark, _random_rows(77, open_share=0.0)), ["k"], "s", "e", ["r"], value_cols=["v"]
    )
    once = flatten_sequential_rows_mixed_datatypes(closed, ["k"], "s", "e")
    twice = flatten_sequential_rows_mixed_datatypes(once, ["k"], "s", "e")
    assert once.count() < closed.count()
    assert rows_of(once) == rows_of(twice)


# ---------------------------------------------------------------- joins


@pytest.mark.parametrize("how", ["inner", "left"])
def test_overlap_join_matches_brute_force(spark, hot, how):
    far = 10_000
    lrows, rrows = _random_rows(21, n=30), _random_rows(22, n=30)
    left = table(spark, lrows, "k int, lv string, ls timestamp, le timestamp, lr int")
    right = table(spark, rrows, "k int, rv string, rs timestamp, re timestamp, rr int")
    out = interval_overlap_join(left, right, ["k"], "ls", "le", "rs", "re", how, hot_rows=hot)
    want = []
    for a in lrows:
        hits = [
            (a[4], b[4])
            for b in rrows
            if a[0] == b[0]
            and a[2] < (far if b[3] is None else b[3])
            and b[2] < (far if a[3] is None else a[3])
        ]
        want += hits or ([(a[4], None)] if how == "left" else [])
    assert sorted(rows_of(out, "lr", "rr"), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_point_in_interval_matches_brute_force(spark, hot, how):
    far = 10_000
    rng = random.Random(3)
    points = [(rng.randint(1, 3), i, rng.randint(0, 60)) for i in range(40)] + [(9, 99, 5)]
    rows = _random_rows(31, n=30)
    facts = spark.createDataFrame([(k, i, day(p)) for k, i, p in points], "k int, i int, p timestamp")
    out = point_in_interval_join(
        facts, table(spark, rows), ["k"], "p", "s", "e", "1900-01-01", how, hot_rows=hot
    )
    want = []
    for k, i, p in points:
        hits = [
            (i, r[4]) for r in rows if r[0] == k and r[2] <= p < (far if r[3] is None else r[3])
        ]
        want += hits or ([(i, None)] if how == "left" else [])
    assert sorted(rows_of(out, "i", "r"), key=str) == sorted(want, key=str)


def test_common_interval_join_matches_brute_force(spark, hot):
    names = ["a", "b", "c"]
    data = [_random_rows(40 + i, keys=2, n=14) for i in range(3)]
    tables = [
        (
            table(spark, rows, f"k int, {t}v string, {t}s timestamp, {t}e timestamp, {t}r int"),
            f"{t}s",
            f"{t}e",
        )
        for t, rows in zip(names, data, strict=True)
    ]
    out = common_interval_join(tables, ["k"], hot_rows=hot)
    want = []
    for a in data[0]:
        for b in data[1]:
            for c in data[2]:
                if a[0] == b[0] == c[0]:
                    lo = max(x[2] for x in (a, b, c))
                    ends = [x[3] for x in (a, b, c) if x[3] is not None]
                    hi = min(ends) if ends else None
                    # With no end at all the comparison is NULL, so the row drops out.
                    if hi is not None and lo < hi:
                        want.append((a[4], b[4], c[4], day(lo), day(hi)))
    got = rows_of(out, "ar", "br", "cr", "interval_start", "interval_end")
    assert sorted(got) == sorted(want)


def test_extend_back(spark, hot):
    df = table(spark, [(1, "A", 3, 5, 1), (1, "B", 6, 9, 2), (2, "C", 4, 5, 3)]).withColumn(
        "first_seen", F.lit(day(1))
    )
    out = extend_back(df, ["s"], "k", "first_seen", "from", hot_rows=hot)
    assert rows_of(out, "v", "from") == [("A", day(1)), ("B", day(6)), ("C", day(1))]


def test_running_ordinal(spark, hot):
    rng = random.Random(5)
    rows = [(rng.randint(1, 3), "x", rng.randint(1, 20), None, i) for i in range(60)]
    rows.append((1, "x", None, None, 99))
    out = running_ordinal(table(spark, rows), ["k"], ["s", "r"], "nth", hot_rows=hot)
    want = []
    for key in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] or 0, r[4]))
        want += [(r[4], n) for n, r in enumerate(mine, 1)]
    assert rows_of(out, "r", "nth") == sorted(want)


def test_more_hot_keys_than_are_listed(spark, monkeypatch):
    from spanmart.operators import hotkeys

    real = hotkeys.find_hot_keys

    def one_hot_key_at_most(parts, keys, hot_rows, max_hot=1):
        found = real(parts, keys, hot_rows, max_hot)
        # The second hot key stays on the regular path.
        assert hot_rows is None or isinstance(hot_rows, hotkeys.HotKeys) or found.listed.count() == 1
        return found

    for module in ("intervals", "flatten", "interval_joins", "ordinals"):
        monkeypatch.setattr(f"spanmart.operators.{module}.find_hot_keys", one_hot_key_at_most)
    rows = _random_rows(61)
    df = table(spark, rows)
    out = sequentialize_table(
        df, ["k"], "s", "e", ["r"], value_cols=["v", "r"], flag_overlaps_column="f", hot_rows=2
    )
    assert sorted(rows_of(out, "k", "v", "s", "e", "r", "f"), key=str) == _brute_sequentialize(rows)
    flat = flatten_sequential_rows(df, ["k"], "s", "e", ["v"], hot_rows=2)
    assert sorted(rows_of(flat), key=str) == _brute_flatten(rows, [0], [1])
    merged = merge_sequential_intervals(
        df, df, ["k"], "s", "e", ["r"], "s", "e", ["r"], hot_rows=2
    )
    plain = merge_sequential_intervals(
        df, df, ["k"], "s", "e", ["r"], "s", "e", ["r"], hot_rows=None
    )
    assert sorted(rows_of(merged), key=str) == sorted(rows_of(plain), key=str)


def test_rows_are_made_once(spark):
    """Bounds and rows come from one shuffle, so what a table is derived from is not computed for each."""

    # Every row made adds one, so a second derivation shows.
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            made.add(1)
            yield r

    rows = [(n % 7, f"v{n}", day(n), day(n + 3), n) for n in range(70)]
    rdd = spark.sparkContext.parallelize(rows, 2).mapPartitions(count)
    df = spark.createDataFrame(rdd, "k int, v string, s timestamp, e timestamp, r int")
    found = sequentialize_table(df, ["k"], "s", "e", ["r"], value_cols=["v"], hot_rows=None)
    assert len(found.collect()) > 0 and made.value == 70
