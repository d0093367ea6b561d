"""Operators that take and return validity-interval tables.

An interval table has key columns, a start and an end ([start, end), NULL end
= still open) and value columns. Rows with a NULL key never take part, because
these operators match keys by equality.

Elementary intervals are the pieces between neighbouring bounds of one key;
nothing changes inside a piece. Keys that fit a task are worked on after one
shuffle by key. Keys with more rows than ``hot_rows`` are worked on in slices
and cells of their timeline (see ``hotkeys``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmart.functions.predicates import all_not_null, any_not_null, far_future_for
from spanmart.operators.hotkeys import BINS, Cuts, HotKeys, both_paths, find_hot_keys, place_of
from spanmart.operators.interval_joins import PAIR_ROWS, key_condition, stab_join

# "Beyond any date" for overlap detail, a fixed value.
DETAIL_END = "9999-12-31"

# Each level of the cell tree spans 2^2 = 4 nodes of the level below.
_TREE_BITS = 2
# Bounds per cell, whose pieces and rows are compared pairwise.
CELL_ROWS = 128
# Rows wider than this do not travel through the tree.
WIDE_BYTES = 96
# Up to so many values of fixed width are columns of their own: a struct would be sorted to be aggregated.
FLAT_VALUES = 16


def _need_keys(keys: list[str]) -> None:
    if not keys:
        raise ValueError("interval operators need at least one key column")


def _bounds(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(F.col(start), F.col(end))).alias("__at"))


def _shared_bounds(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The bounds of rows that are shuffled already and read a second time elsewhere.

    All columns are looked at. A branch that reads fewer would be pruned below the shuffle,
    and the rows be made and shuffled once for each branch in place of once for both.
    """
    whole = F.size(F.array(F.struct(*[F.col(c) for c in rows.columns]))) == 1
    ends = F.when(whole, F.array(F.col(start), F.col(end)))
    return rows.select(*keys, F.explode(ends).alias("__at"))


def _pieces(points: DataFrame, keys: list[str]) -> DataFrame:
    """Pair each bound with the next one of its key; ``__tail`` marks the last bound.

    Keys must be regular and points shuffled by them, which serves distinct and window.
    """
    by_key = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_last())
    return (
        points.distinct()
        .select(
            *keys,
            F.col("__at").alias("__from"),
            F.lead("__at").over(by_key).alias("__to"),
            F.lead(F.lit(True)).over(by_key).isNull().alias("__tail"),
        )
    )


def _bound_cuts(points: DataFrame, hot: HotKeys, max_cuts: int | None = None) -> Cuts:
    """Cells of even numbers of bounds."""
    more = {} if max_cuts is None else {"max_cuts": max_cuts}
    points = _sampled_bounds(points, hot)
    place = place_of(points, "__at")
    return hot.cuts(points, F.col("__at"), rows=CELL_ROWS, place=place, bins=BINS, **more)


def _sampled_bounds(points: DataFrame, hot: HotKeys) -> DataFrame:
    """The bounds to cut by: those of the sources, if they are known and of the same type."""
    known = hot.bounds is not None and hot.bounds.schema["__at"].dataType == points.schema["__at"].dataType
    return hot.bounds if known else points


def _cell_pieces(points: DataFrame, keys: list[str], cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """Pieces of hot keys with their cell, and the cells that have pieces.

    Bounds (never NULL) are made distinct with a map-side step and paired inside cells; a cell's last bound
    is paired with the first one of the next cell, of which one narrow row per cell is looked at.
    """
    celled = cuts.celled(cuts.on(points), "__cell", F.col("__at"), place_of(points, "__at"))
    celled = celled.select(*keys, "__cell", "__at")
    on = [*keys, "__cell"]
    firsts = celled.groupBy(*on).agg(F.min("__at").alias("__first"))
    slice_of = F.floor(F.col("__cell") / cuts.bins)
    follow = lambda part, by: F.lead("__first").over(Window.partitionBy(*part).orderBy(by))
    if cuts.bins == 1 or cuts.table is None:
        nexts = firsts.withColumn("__next_first", follow(keys, "__cell"))
    else:
        # Cells of a slice first, then one row per slice.
        firsts = firsts.withColumn("__slice", slice_of)
        heads = firsts.groupBy(*keys, "__slice").agg(F.min("__first").alias("__first"))
        heads = heads.withColumn("__later", follow(keys, "__slice")).select(
            *[F.col(c).alias(f"__h_{c}") for c in [*keys, "__slice"]], "__later"
        )
        nexts = firsts.withColumn("__inner", follow([*keys, "__slice"], "__cell"))
        nexts = nexts.join(heads, key_condition(nexts, heads, [*keys, "__slice"], "__h_"))
        nexts = nexts.withColumn("__next_first", F.coalesce("__inner", "__later"))
    nexts = nexts.select(*[F.col(c).alias(f"__o_{c}") for c in on], "__next_first")
    in_cell = Window.partitionBy(*on).orderBy("__at")
    paired = celled.distinct().withColumn("__next", F.lead("__at").over(in_cell))
    pieces = paired.join(nexts, key_condition(paired, nexts, on, "__o_")).select(
        *on,
        F.col("__at").alias("__from"),
        F.coalesce("__next", "__next_first").alias("__to"),
    )
    return pieces, firsts.select(*on)


# --------------------------------------------------------------------------
# Sequentialize
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class _Choice:
    """What is picked per piece: packed values, the order that decides, and flags."""

    keys: list[str]
    start: str
    end: str
    values: list[str]
    flag: str | None
    flat: bool = False

    @property
    def packed(self) -> list[str]:
        """The columns in which values travel."""
        if self.flat:
            return [f"__v{i}" for i in range(len(self.values))]
        return ["__values"] if self.values else []

    def aggregates(self, rows: Column, packed: list[str] | None = None) -> list[Column]:
        out = [F.sum(rows).alias("__n")] if self.flag else []
        if self.values:
            # All columns see the same rows in the same order, so they keep the values of one row in ties too.
            out += [F.max_by(c, "__order").alias(c) for c in (self.packed if packed is None else packed)]
            out.append(F.max("__order").alias("__order"))
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        out = [
            *self.keys,
            F.col("__from").alias(self.start),
            F.col("__to").alias(self.end),
            *[
                (F.col(f"__v{i}") if self.flat else F.col("__values").getField(v)).alias(v)
                for i, v in enumerate(self.values)
            ],
        ]
        if self.flag:
            out.append((F.col("__n") > 1).alias(self.flag))
        return df.select(*out)


def sequentialize_table(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    order_cols: list[str],
    pre_filter: Column | None = None,
    value_cols: list[str] | None = None,
    flag_overlaps_column: str | None = None,
    far_future: object = None,
    sort: bool = False,
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Break overlapping intervals into pieces, one row per key and piece.

    Where several rows cover a piece, values come from the row with the highest
    ``order_cols``. One order column ignores rows where it is NULL; several
    form a tuple in which NULL sorts lowest. Rows with ``start >= end`` are
    dropped and uncovered time gives no row. ``value_cols=None`` keeps all
    other columns, ``[]`` none. ``flag_overlaps_column`` adds a boolean that
    tells whether more than one row covered the piece.
    """
    _need_keys(keys)
    if not order_cols:
        raise ValueError("order_cols must name at least one column")
    if value_cols is None:
        value_cols = [c for c in df.columns if c not in {*keys, start, end}]
        if not value_cols:
            raise ValueError("the table has no value columns; pass value_cols=[] for none")
    if pre_filter is not None:
        df = df.filter(pre_filter)
    far = far_future_for(df, end, far_future)
    valid = df.filter(all_not_null(keys) & (F.col(start) < F.coalesce(F.col(end), far)))
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    flat = len(value_cols) <= FLAT_VALUES and _fixed_width(valid.select(*value_cols, order))
    choice = _Choice(keys, start, end, list(value_cols), flag_overlaps_column, flat)
    values = [F.col(v).alias(c) for v, c in zip(value_cols, choice.packed)] if flat else [F.struct(*value_cols).alias("__values")]
    packed = [*values, order.alias("__order")]
    rows = valid.select(
        *keys,
        F.col(start).alias("__start"),
        F.col(end).alias("__end"),
        *(packed if value_cols else []),
    )

    hot = find_hot_keys([rows], keys, hot_rows)
    result = choice.finish(_pick_by_key(hot.regular(rows), choice, far))
    if hot.found:
        result = both_paths(result, choice.finish(_pick_by_cell(hot, rows, choice, far)))
    return result.orderBy(*keys, start, end) if sort else result


def _pick_by_key(rows: DataFrame, choice: _Choice, far: Column) -> DataFrame:
    keys = choice.keys
    rows = rows.repartition(*keys)
    pieces = _pieces(_shared_bounds(rows, keys, "__start", "__end"), keys).filter(~F.col("__tail"))
    covered = rows.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        "__start",
        F.coalesce(F.col("__end"), far).alias("__stop"),
        *[c for c in rows.columns if c not in {*keys, "__start", "__end"}],
    )
    # A piece lies inside a row or outside it, so its start decides.
    meets = (
        key_condition(pieces, covered, keys, "__r_")
        & (F.col("__start") <= F.col("__from"))
        & (F.col("__from") < F.col("__stop"))
    )
    return (
        pieces.join(covered, meets)
        .groupBy(*keys, "__from", "__to")
        .agg(*choice.aggregates(F.lit(1)) or [F.lit(1).alias("__one")])
    )


def _pick_by_cell(
    hot: HotKeys, rows: DataFrame, choice: _Choice, far: Column, max_cuts: int | None = None
) -> DataFrame:
    """Best row per piece without pairing rows with pieces of a whole key.

    A row meets the pieces of the two cells in which it starts and ends. The cells between
    lie inside it, so all their pieces need to know is the best of such rows: a row's run of cells
    splits into a few whole nodes per level of a tree over the cells, the best row of a node is a plain
    aggregate, and a cell looks at the nodes above it. Work is n log n even when all rows of a key
    overlap, and is hashed by cell and node, not by key.
    """
    keys = choice.keys
    # A row goes to several nodes. Wide rows send only their bounds there, and the
    # values of the winners are fetched once, at the end.
    fetch = bool(choice.values) and _width(rows, choice.packed) > WIDE_BYTES
    carried = ["__w_start", "__w_end"] if fetch else choice.packed
    bounds = lambda df: _bounds(df, keys, "__start", "__end").filter(F.col("__at").isNotNull())
    cuts = _bound_cuts(bounds(rows), hot, max_cuts)
    counted = lambda df: df.agg(*choice.aggregates(F.lit(1)) or [F.lit(1).alias("__one")])
    summed = lambda df: df.agg(*choice.aggregates(F.col("__n"), carried) or [F.lit(1).alias("__one")])
    # Copies of one interval cover the same pieces: they are combined first, and map-side.
    spans = counted(hot.hot(rows).groupBy(*keys, "__start", "__end"))
    points = bounds(spans)
    pieces, cells = _cell_pieces(points, keys, cuts)

    narrow = spans
    if fetch:
        narrow = spans.drop(*choice.packed).withColumns({"__w_start": F.col("__start"), "__w_end": F.col("__end")})
    kind = points.schema["__at"].dataType
    timed = narrow.withColumns(
        {"__stop": F.coalesce(F.col("__end"), far), "__s": F.col("__start").cast(kind)}
    ).withColumn("__e", F.col("__stop").cast(kind))
    filed = cuts.on(timed)
    for bound, cell in (("__s", "__a"), ("__e", "__b")):
        filed = cuts.celled(filed, cell, F.col(bound), place_of(timed, bound))
    payload = (["__n"] if choice.flag else []) + ([*carried, "__order"] if choice.values else [])
    renamed = [F.col(k).alias(f"__r_{k}") for k in keys]

    # An outer explode infers no filter, which would evaluate the cells again below.
    local = filed.withColumn("__r_cell", F.explode_outer(F.array_distinct(F.array("__a", "__b"))))
    local = local.select(*renamed, "__r_cell", "__start", "__stop", *payload)
    covered = local
    if cuts.table is not None:
        spanning = _spanning(filed, cells, choice, cuts, payload, summed)
        covered = local.unionByName(spanning, allowMissingColumns=True)
    meets = (
        key_condition(pieces, covered, keys, "__r_")
        & (pieces["__cell"] == covered["__r_cell"])
        & (
            covered["__start"].isNull()
            | ((covered["__start"] <= pieces["__from"]) & (pieces["__from"] < covered["__stop"]))
        )
    )
    best = summed(
        pieces.join(covered, meets)
        .select(*keys, "__cell", "__from", "__to", *payload)
        .groupBy(*keys, "__cell", "__from", "__to")
    ).drop("__cell")
    if not fetch:
        return best
    found = spans.select(*[F.col(k).alias(f"__v_{k}") for k in keys], "__start", "__end", *choice.packed)
    # No winner where every order is NULL.
    same = (
        key_condition(best, found, keys, "__v_")
        & (F.col("__w_start") == F.col("__start"))
        & F.col("__w_end").eqNullSafe(F.col("__end"))
    )
    return best.join(found, same, "left")


def _spanning(
    filed: DataFrame, cells: DataFrame, choice: _Choice, cuts: Cuts, payload: list[str], summed: Callable
) -> DataFrame:
    """The best of the rows that span a whole cell, for each cell; there are none without cuts."""
    keys = choice.keys
    renamed = [F.col(k).alias(f"__r_{k}") for k in keys]
    between = filed.withColumns({"__lo": F.col("__a") + 1, "__hi": F.greatest("__b", F.col("__a") + 1)})
    # Rows share the halves of their runs of cells, and are combined by them before they meet the nodes.
    halves = between.withColumn("__mid", _middle()).withColumn(
        "__half",
        F.explode(F.array(F.struct(F.col("__lo").alias("lo"), F.col("__mid").alias("hi")), F.struct(F.col("__mid").alias("lo"), F.col("__hi").alias("hi")))),
    )
    halves = halves.select(*keys, F.col("__half.lo").alias("__lo"), F.col("__half.hi").alias("__hi"), *payload)
    halves = summed(halves.filter(F.col("__lo") < F.col("__hi")).groupBy(*keys, "__lo", "__hi"))
    nodes = summed(
        halves.withColumn("__node", F.explode_outer(_covering_nodes()))
        .filter(F.col("__node").isNotNull())
        .withColumns({"__n_level": F.col("__node.level"), "__n_id": F.col("__node.id")})
        .groupBy(*[F.col(k).alias(f"__n_{k}") for k in keys], "__n_level", "__n_id")
    )
    height = -(-max(cuts.cells, 1).bit_length() // _TREE_BITS)
    levels = cells.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(height)))).withColumn(
        "__id", F.expr(f"shiftright(__cell, cast({_TREE_BITS} * __level as int))")
    )
    above = (
        key_condition(levels, nodes, keys, "__n_")
        & (levels["__level"] == nodes["__n_level"])
        & (levels["__id"] == nodes["__n_id"])
    )
    return summed(
        levels.join(nodes, above).groupBy(*renamed, F.col("__cell").alias("__r_cell"))
    )


def _fixed_width(df: DataFrame) -> bool:
    """Whether Spark can aggregate all columns in a hash table; others it sorts."""
    kinds = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(f.dataType, kinds) for f in df.schema.fields)


def _width(df: DataFrame, cols: list[str]) -> int:
    """Rough bytes per row of these columns, by type."""

    def size(dtype: T.DataType) -> int:
        if isinstance(dtype, T.StructType):
            return sum(size(f.dataType) for f in dtype.fields)
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            return 32
        return 128 if isinstance(dtype, (T.ArrayType, T.MapType)) else 8

    return sum(size(df.schema[c].dataType) for c in cols)


def _tree_height(count: Column) -> Column:
    """A level at which one node spans ``count`` leaves."""
    return F.ceil(F.length(F.bin(count)) / F.lit(_TREE_BITS)).cast("int")


def _middle() -> Column:
    """The roundest number of __lo … __hi in binary: runs of cells that begin or end alike have few of them."""
    apart = F.length(F.bin((F.col("__lo") - 1).bitwiseXOR(F.col("__hi")))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", F.col("__hi"), apart), apart)


def _covering_nodes() -> Column:
    """Whole nodes that make up the leaves [__lo, __hi), as (level, id) structs.

    At level n the whole nodes inside the range are ceil(lo/4^n) … floor(hi/4^n).
    Those whose parent is inside the range as well are left to the next level.
    """
    height = _tree_height(F.col("__hi") - F.col("__lo"))

    def at_level(level: Column) -> Column:
        width = F.pow(F.lit(float(1 << _TREE_BITS)), level).cast("long")
        first = F.ceil(F.col("__lo") / width)
        last = F.floor(F.col("__hi") / width)
        fan = F.lit(1 << _TREE_BITS)
        parent_first = F.ceil(first / fan) * fan
        parent_last = F.floor(last / fan) * fan
        apart = parent_first < parent_last
        left_stop = F.when(apart, parent_first).otherwise(last)
        right_start = F.when(apart, parent_last).otherwise(last)
        ids = F.concat(_ids(first, left_stop), _ids(right_start, last))
        return F.transform(
            ids, lambda i: F.struct(level.alias("level"), i.cast("long").alias("id"))
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), height), at_level))


def _ids(first: Column, stop: Column) -> Column:
    """first, first + 1 … stop - 1; empty when there is none."""
    first, stop = first.cast("long"), stop.cast("long")
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


# --------------------------------------------------------------------------
# Merge
# --------------------------------------------------------------------------


def _merged_names(
    cols: list[str], others: list[str], removed: set[str], common: str, keep: str, prefix: str
) -> dict[str, str]:
    """Source column → output name for one side of a merge."""
    names = {}
    for col in cols:
        if col in removed:
            continue
        if col not in others:
            names[col] = col
        elif common == "both":
            names[col] = prefix + col
        elif common == keep:
            names[col] = col
    return names


def merge_sequential_intervals(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    l_start: str,
    l_end: str,
    l_cols: list[str],
    r_start: str,
    r_end: str,
    r_cols: list[str],
    join_type: str = "left",
    common: str = "both",
    l_prefix: str = "left_",
    r_prefix: str = "right_",
    incremental: tuple[DataFrame, list[str], str] | None = None,
    sequential: bool = False,
    far_future: object = None,
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Merge two interval tables into their common pieces, with columns of both.

    'left' keeps time the left table covers, 'outer' time either covers.
    Column names both sides have are prefixed ('both') or taken from one side.
    The result (keys, interval_start, interval_end, left and right columns) is
    not flattened again. ``incremental`` is (target, output timestamp columns,
    target mark) and keeps the rows newer than the target.

    ``sequential=True`` declares that no two rows of one side overlap for a
    key, as after ``sequentialize_table``. The merge is then one ordered pass
    after a single shuffle, without joins; overlapping rows make the job fail.
    """
    _need_keys(keys)
    if join_type not in ("left", "outer"):
        raise ValueError(f"join_type must be 'left' or 'outer', got {join_type!r}")
    if common not in ("both", "left", "right"):
        raise ValueError(f"common must be 'both', 'left' or 'right', got {common!r}")
    l_names = _merged_names(l_cols, r_cols, {*keys, l_start, l_end}, common, "left", l_prefix)
    r_names = _merged_names(r_cols, l_cols, {*keys, r_start, r_end}, common, "right", r_prefix)
    out_names = [*l_names.values(), *r_names.values()]
    if len(set(out_names)) != len(out_names):
        raise ValueError(f"output column names repeat: {out_names}")

    def side(df: DataFrame, start: str, end: str, names: dict[str, str], tag: str) -> DataFrame:
        return df.filter(all_not_null(keys)).select(
            *keys,
            F.col(start).alias(f"__{tag}_start"),
            F.col(end).alias(f"__{tag}_end"),
            *[F.col(c).alias(f"__{tag}_{name}") for c, name in names.items()],
        )

    sides = {
        "l": side(left, l_start, l_end, l_names, "l"),
        "r": side(right, r_start, r_end, r_names, "r"),
    }
    far = far_future_for(left, l_end, far_future)
    hot = find_hot_keys(list(sides.values()), keys, hot_rows)

    def shape(joined: DataFrame) -> DataFrame:
        if join_type == "outer":
            joined = joined.filter(F.col("__l_hit") | F.col("__r_hit"))
        return joined.select(
            *keys,
            F.col("__from").alias("interval_start"),
            F.col("__to").alias("interval_end"),
            *[F.col(f"__l_{name}").alias(name) for name in l_names.values()],
            *[F.col(f"__r_{name}").alias(name) for name in r_names.values()],
        )

    hows = {"l": "inner" if join_type == "left" else "left", "r": "left"}
    if sequential:
        merged = shape(_merge_by_sweep(hot, sides, keys, far, keep_right=join_type == "outer"))
    else:
        merged = shape(_merge_by_key(hot, sides, keys, far, hows))
        if hot.found:
            sliced = shape(_merge_by_buckets(hot, sides, keys, far, hows))
            merged = both_paths(merged, sliced)
    if incremental is not None:
        target, marks, merged_mark = incremental
        merged = newer_than(merged, target, marks, merged_mark)
    return merged


def _all_points(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    found = [_bounds(df, keys, f"__{tag}_start", f"__{tag}_end") for tag, df in sides.items()]
    return reduce(DataFrame.unionByName, found).filter(F.col("__at").isNotNull())


def _merge_by_key(
    hot: HotKeys, sides: dict[str, DataFrame], keys: list[str], far: Column, hows: dict[str, str]
) -> DataFrame:
    parts = {tag: hot.regular(df) for tag, df in sides.items()}
    joined = _pieces(_all_points(parts, keys).repartition(*keys), keys).drop("__tail")
    for tag, how in hows.items():
        joined = _cover_by_key(joined, parts[tag], keys, tag, far, how)
    return joined


def _merge_by_buckets(
    hot: HotKeys, sides: dict[str, DataFrame], keys: list[str], far: Column, hows: dict[str, str]
) -> DataFrame:
    points = _all_points(sides, keys)
    cuts = _bound_cuts(points, hot)
    pieces = _cell_pieces(points, keys, cuts)[0].drop("__cell")
    # A piece lies inside a row or outside it, so its start decides.
    others = [
        (
            sides[tag].withColumn(f"__{tag}_hit", F.lit(True)),
            F.col(f"__{tag}_start"),
            F.coalesce(F.col(f"__{tag}_end"), far),
            False,
            how,
        )
        for tag, how in hows.items()
    ]
    return stab_join(pieces, "__from", others, keys, cuts)


def _merge_by_sweep(
    hot: HotKeys, sides: dict[str, DataFrame], keys: list[str], far: Column, keep_right: bool
) -> DataFrame:
    """Walk the bounds of a key in order, carrying the last row of each side."""
    values = {
        tag: [c for c in df.columns if c not in {*keys, f"__{tag}_start", f"__{tag}_end"}]
        for tag, df in sides.items()
    }

    def events(tag: str) -> DataFrame:
        df = sides[tag]
        start, end = F.col(f"__{tag}_start"), F.col(f"__{tag}_end")
        row = F.struct(F.coalesce(end, far).alias("end"), *values[tag])
        opens = F.struct(start.alias("at"), F.when(start < F.coalesce(end, far), row).alias("row"))
        closes = F.struct(end.alias("at"), F.lit(None).alias("row"))
        bounds = df.select(*keys, F.explode(F.array(opens, closes)).alias("__event"))
        return bounds.select(
            *keys, F.col("__event.at").alias("__at"), F.col("__event.row").alias(f"__{tag}_row")
        ).filter(F.col("__at").isNotNull())

    both = events("l").unionByName(events("r"), allowMissingColumns=True)
    tags = list(sides)

    def walk(group: list[str]):
        window = Window.partitionBy(*group).orderBy("__at")
        here = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        added = {"__to": F.lead("__at").over(window)}
        for tag in tags:
            row = F.col(f"__{tag}_row")
            added[f"__{tag}_last"] = F.last(row, ignorenulls=True).over(here)
            added[f"__{tag}_prev"] = F.last(row, ignorenulls=True).over(earlier)
        return added

    def finish(walked: DataFrame) -> DataFrame:
        clash = reduce(
            lambda a, b: a | b,
            (
                F.col(f"__{t}_row").isNotNull()
                & F.coalesce(F.col(f"__{t}_prev.end") > F.col("__at"), F.lit(False))
                for t in tags
            ),
        )
        message = F.lit("rows of one side overlap; merge them with sequential=False")
        active = {t: F.coalesce(F.col(f"__{t}_last.end") > F.col("__at"), F.lit(False)) for t in tags}
        kept = (active["l"] | active["r"]) if keep_right else active["l"]
        # Of the events at one instant the last one starts the piece.
        starts_piece = F.coalesce(F.col("__to") > F.col("__at"), F.lit(True))
        # The check comes first, so that every event passes it.
        checked = walked.filter(
            F.when(clash, F.raise_error(message).cast("boolean")).otherwise(starts_piece & kept)
        )
        return checked.select(
            *keys,
            F.col("__at").alias("__from"),
            "__to",
            *[active[t].alias(f"__{t}_hit") for t in tags],
            *[
                F.when(active[t], F.col(f"__{t}_last").getField(c)).alias(c)
                for t in tags
                for c in values[t]
            ],
        )

    merged = finish(hot.regular(both).withColumns(walk(keys)))
    if not hot.found:
        return merged

    place = place_of(both, "__at")
    cuts = hot.cuts(_sampled_bounds(both, hot), F.col("__at"), place=place)
    sliced = cuts.placed(cuts.on(both), "__slice", F.col("__at"), place=place)
    sliced = sliced.select(*both.columns, "__slice")
    newest = [
        F.max_by(f"__{t}_row", F.when(F.col(f"__{t}_row").isNotNull(), F.col("__at"))).alias(t)
        for t in tags
    ]
    summary = sliced.groupBy(*keys, "__slice").agg(F.min("__at").alias("__first"), *newest)
    across = Window.partitionBy(*keys).orderBy("__slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, "__slice"]
    carried = summary.select(
        *[F.col(k).alias(f"__c_{k}") for k in on],
        F.lead("__first").over(across).alias("__next_first"),
        *[F.last(t, ignorenulls=True).over(before).alias(f"__{t}_carried") for t in tags],
    )
    walked = sliced.withColumns(walk(on))
    walked = walked.join(carried, key_condition(walked, carried, on, "__c_"))
    walked = walked.withColumns(
        {
            "__to": F.coalesce("__to", "__next_first"),
            **{
                f"__{t}_{kind}": F.coalesce(f"__{t}_{kind}", f"__{t}_carried")
                for t in tags
                for kind in ("last", "prev")
            },
        }
    )
    return both_paths(merged, finish(walked))


def _cover_by_key(
    pieces: DataFrame, rows: DataFrame, keys: list[str], tag: str, far: Column, how: str
) -> DataFrame:
    """Join pieces with the rows of one side that cover them."""
    start, stop = f"__{tag}_start", f"__{tag}_stop"
    side = rows.select(
        *[F.col(k).alias(f"__{tag}k_{k}") for k in keys],
        *[c for c in rows.columns if c not in {*keys, f"__{tag}_end"}],
        F.coalesce(F.col(f"__{tag}_end"), far).alias(stop),
        F.lit(True).alias(f"__{tag}_hit"),
    )
    # A piece lies inside a row or outside it, so its start decides.
    meets = (
        key_condition(pieces, side, keys, f"__{tag}k_")
        & (F.col(start) <= F.col("__from"))
        & (F.col("__from") < F.col(stop))
    )
    return pieces.join(side, meets, how).drop(*[f"__{tag}k_{k}" for k in keys])


def newer_than(
    df: DataFrame, target: DataFrame, marks: list[str], merged_mark: str
) -> DataFrame:
    """Rows where some timestamp in ``marks`` lies after the target's newest mark.

    An empty target lets all rows through.
    """
    newest = target.agg(F.max(merged_mark)).scalar()
    return df.filter(newest.isNull() | _after(marks, newest))


def newest_mark(target: DataFrame, mark: str) -> Column | None:
    """The newest mark of a stored table as a constant; None for an empty table."""
    kind = target.schema[mark].dataType
    newest = target.agg(F.max(mark).cast("string")).first()[0]
    return None if newest is None else F.lit(newest).cast(kind)


def newer_than_value(df: DataFrame, marks: list[str], newest: Column | None) -> DataFrame:
    """Rows where some timestamp in ``marks`` lies after a known mark; all rows without one."""
    return df if newest is None else df.filter(_after(marks, newest))


def _after(marks: list[str], newest: Column) -> Column:
    if not marks:
        raise ValueError("an incremental run needs at least one timestamp column")
    return reduce(lambda a, b: a | b, (F.col(m) > newest for m in marks))


# --------------------------------------------------------------------------
# Overlap detail
# --------------------------------------------------------------------------


def get_overlap_detail(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    order_cols: list[str],
    far_future: object = None,
    detail_end: object = DETAIL_END,
    hot_rows: int | None | HotKeys = PAIR_ROWS,
) -> DataFrame:
    """Every source row that takes part in an overlap, once per overlapping piece.

    Adds ``overlap_start`` and ``overlap_end``. Open ends are compared as
    ``detail_end`` here.
    """
    hot = find_hot_keys([df], keys, hot_rows)
    flagged = sequentialize_table(
        df,
        keys,
        start,
        end,
        order_cols,
        value_cols=[],
        flag_overlaps_column="__overlapping",
        far_future=far_future,
        hot_rows=hot,
    )
    overlaps = flagged.filter("__overlapping").select(
        *keys, F.col(start).alias("overlap_start"), F.col(end).alias("overlap_end")
    )
    detail = far_future_for(df, end, detail_end)
    out = [*df.columns, "overlap_start", "overlap_end"]
    regular = hot.regular(df)
    periods = hot.regular(overlaps).select(
        *[F.col(k).alias(f"__o_{k}") for k in keys], "overlap_start", "overlap_end"
    )
    meets = (
        key_condition(regular, periods, keys, "__o_")
        & (F.col("overlap_start") < F.coalesce(F.col(end), detail))
        & (F.coalesce(F.col("overlap_end"), detail) > F.col(start))
    )
    regular = regular.join(periods, meets).select(*out).filter(any_not_null(keys))
    if not hot.found:
        return regular
    far = far_future_for(df, end, far_future)
    proper = F.coalesce(F.col(start) < F.coalesce(F.col(end), far), F.lit(False))
    points = _bounds(df.filter(proper), keys, start, end).filter(F.col("__at").isNotNull())
    cuts = _bound_cuts(points, hot)
    last = F.coalesce(F.col(end), detail)
    # Pieces were cut at the bounds of proper rows, so a piece's start decides.
    rows = df.filter(proper)
    inside = stab_join(overlaps, "overlap_start", [(rows, F.col(start), last, False, "inner")], keys, cuts)
    # Rows that cut nothing (empty or inverted) are compared bound by bound.
    rows = df.filter(~proper).withColumn("__last", last)
    period = (overlaps, F.col("overlap_start"), F.coalesce(F.col("overlap_end"), detail), False, "inner")
    across = stab_join(rows.filter(F.col(start).isNotNull()), start, [period], keys, cuts).filter(
        F.col("overlap_start") < F.col("__last")
    )
    # One of them may still be longer than nothing where open ends count as later here.
    longer = stab_join(
        overlaps, "overlap_start", [(rows, F.col(start), F.col("__last"), True, "inner")], keys, cuts
    ).filter(F.coalesce(F.col("overlap_end"), detail) > F.col(start))
    sliced = reduce(DataFrame.unionByName, [part.select(*out) for part in (inside, across, longer)])
    return both_paths(regular, sliced)
