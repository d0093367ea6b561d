"""Finding keys that hold too many rows for one task, and cutting them into even slices.

Windows and interval joins keep one key's rows together. That is the cheapest
plan (one shuffle) while every key is small, and the worst one when a single
key holds a third of the table. The interval operators therefore run one narrow
counting job first and send the few hot keys down a path whose work is spread
over slices of the key's own order. Every path gives the same rows.

Slices are cut at quantiles of the rows themselves, found on a sample: by any
columns of any ordered type, so that many rows on one day, a far-away sentinel
or dates held as text are cut as evenly as anything else. The cuts are values on
the driver, sent to every task; the same row therefore always falls into the
same slice, whatever is computed twice or again.

The list of hot keys comes to the driver only up to ``max_hot`` entries,
largest first, and all their cuts up to about ``MAX_CUTS``, which bounds what is
broadcast. Only keys of more rows than a slice are cut: cuts follow the rows and
not the number of hot keys. Keys beyond the list stay on the regular path; none
of them can hold more than 1/max_hot of the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_HOT_KEYS = 100_000
# Slices per hot_rows rows: what a slice holds is then well below what a task can take.
SLICE_FACTOR = 4
# Slices of fewer rows cost more than they spread.
LEAST_SLICE = 64
# Cuts over all hot keys together, and rows sampled for each of them.
MAX_CUTS = 1 << 14
# Where slices are divided into bins, fewer of them do.
MAX_BINNED_CUTS = 1 << 12
SAMPLED = 24
# Buckets per cut, so that a bucket has few cuts.
BUCKETS = 4
# Bins per slice, where the work wants small cells.
BINS = 16


def position(df: DataFrame, col: str) -> Column:
    """A column of any ordered type as a BIGINT that keeps the order.

    Distinct values may share a position; slices and bins only need order.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(col)).cast("long")
    if isinstance(dtype, T.IntegralType):
        return F.col(col).cast("long")
    if isinstance(dtype, T.NumericType):
        # Beyond the range of a BIGINT all values share its ends.
        edge = F.lit(float(1 << 62))
        as_double = F.col(col).cast("double")
        inside = F.floor(F.greatest(-edge, F.least(edge, F.nanvl(as_double, edge)))).cast("long")
        return inside
    raise ValueError(f"{col} has type {dtype.simpleString()}, which cannot place it on a timeline")


def place_of(df: DataFrame, col: str) -> Column | None:
    """The position of a column, or None for types without a number line, such as text."""
    dtype = df.schema[col].dataType
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)
    return position(df, col) if isinstance(dtype, kinds) else None


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], right_prefix: str = "") -> Column:
    """NULL-safe equality on the keys, usable as a hash-join condition."""
    return reduce(
        lambda a, b: a & b, (left[k].eqNullSafe(right[right_prefix + k]) for k in keys)
    )


# Cuts are values in the plan. Written and read with all digits; even a coarser cut would only be less even.
_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


# Numbers of a search among up to 2^b - 1 cuts, by b.
_STEPS = [[1 << k for k in reversed(range(b))] for b in range(32)]


def _bucket(place: Column, lo: Column, hi: Column, width: Column) -> Column:
    """One of ``width`` + 2 equal steps on the number line; missing places come first."""
    return F.coalesce(F.width_bucket(place.cast("double"), lo, hi, width), F.lit(0)).cast("int")


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass(frozen=True)
class Cuts:
    """Where hot keys are cut into slices.

    The cuts are one constant array in the plan, ``whole``, key after key. ``table`` has a row per hot key
    (``__k_<key>``) with what finds a slice: the key's first cut and their number, and how its number line
    is divided into buckets. ``before`` and ``inside`` tell for each bucket how many cuts lie before it
    and in it, so that a row is compared with the few cuts of its own bucket only. ``edges`` has each cut's
    place; slices are divided into ``bins`` of equal width there. ``table`` is None where no key is cut;
    ``listed`` has all hot keys where some are not, and those have the place ``uncut``.
    """

    keys: list[str]
    table: DataFrame | None
    listed: DataFrame | None
    uncut: Column
    most: int
    whole: Column
    before: Column
    inside: Column
    edges: Column
    bins: int = 1
    bucketed: bool = True

    def by_value(self) -> Cuts:
        """The same slices, found by values alone: for columns of another type than the cuts."""
        return replace(self, bins=1, bucketed=False)

    @property
    def cells(self) -> int:
        """More than any cell number."""
        return self.most * self.bins + 1

    def on(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys, ready for ``placed``; the column ``__cut`` is added."""
        if self.listed is not None:
            hot = F.broadcast(self.listed)
            df = df.join(hot, same_keys(df, hot, self.keys, "__k_"), "left_semi")
        if self.table is None:
            return df.withColumn("__cut", self.uncut)
        small = F.broadcast(self.table)
        how = "inner" if self.listed is None else "left"
        joined = df.join(small, same_keys(df, small, self.keys, "__k_"), how)
        if self.listed is not None:
            joined = joined.withColumn("__cut", F.coalesce("__cut", self.uncut))
        return joined.drop(*[f"__k_{k}" for k in self.keys])

    def placed(self, df: DataFrame, name: str, *order: Column, place: Column | None = None) -> DataFrame:
        """Add the slice of rows from ``on``, by the columns the cuts were made on; 0 is the first, NULLs come first.

        ``place`` is the first column's position, if the cuts were made with one.
        """
        if self.table is None:
            return df.withColumn(name, F.lit(0))
        cut = F.col("__cut")
        row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
        # What is used more than once is a column of its own, so that the plan stays small.
        if place is None or not self.bucketed:
            df = df.withColumns({"__base": F.lit(0), "__many": cut["n"]})
        else:
            bucket = cut["lut"] + _bucket(place, cut["lo"], cut["hi"], cut["width"])
            df = df.withColumn("__bucket", bucket).withColumns(
                {"__base": F.get(self.before, F.col("__bucket")), "__many": F.get(self.inside, F.col("__bucket"))}
            )
        base, many = F.col("__base"), F.col("__many")
        found = F.aggregate(
            F.get(_constant(_STEPS, "array<array<int>>"), _bits(many)),
            F.lit(0),
            lambda at, step: F.when(
                (at + step <= many) & (F.get(self.whole, cut["at"] + base - 1 + at + step) <= row), at + step
            ).otherwise(at),
        )
        at = F.coalesce(base + F.when(many > 0, found).otherwise(0), F.lit(0))
        return df.withColumn(name, at).drop("__bucket", "__base", "__many")

    def celled(self, df: DataFrame, name: str, value: Column, place: Column | None) -> DataFrame:
        """Add slice and bin in one number, growing with ``value``; ``place`` is its position."""
        at, cut = F.col("__at_slice"), F.col("__cut")
        df = self.placed(df, "__at_slice", value, place=place)
        if self.bins == 1 or place is None:
            return df.withColumn(name, at.cast("long")).drop("__at_slice")
        inside = (at > 0) & (at < cut["n"])
        df = df.withColumns(
            {
                "__lower": F.when(inside, F.get(self.edges, cut["at"] + at - 1)).cast("double"),
                "__upper": F.when(inside, F.get(self.edges, cut["at"] + at)).cast("double"),
            }
        )
        lower, upper = F.col("__lower"), F.col("__upper")
        share = (place.cast("double") - lower) / F.when(upper > lower, upper - lower)
        inner = F.least(F.greatest(F.floor(share * self.bins), F.lit(0)), F.lit(self.bins - 1))
        cell = at.cast("long") * self.bins + F.coalesce(inner, F.lit(0)).cast("long")
        return df.withColumn(name, cell).drop("__at_slice", "__lower", "__upper")

    def last_cell(self) -> Column:
        """The cell of what lies behind a key's last cut."""
        return (F.col("__cut.n") * self.bins).cast("long")


def _bits(n: Column) -> Column:
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def _uncut(lut: int) -> Column:
    """The ``__cut`` of a key without cuts; ``lut`` is behind all buckets."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(lut).alias("lut"),
        none.alias("lo"), none.alias("hi"), F.lit(1).cast("long").alias("width"),
    )


@dataclass(frozen=True)
class HotKeys:
    """Hot keys and how many rows each has, as a local table (``__k_<key>``, ``__n``) and as its rows."""

    keys: list[str]
    hot_rows: int = 0
    listed: DataFrame | None = None
    total: int = 0
    bounds: DataFrame | None = None
    counts: tuple[Row, ...] = ()

    def with_bounds(self, *tables: tuple[DataFrame, str, str]) -> HotKeys:
        """Sample cuts of time from these (table, start, end) in place of what is derived from them.

        Spares running a derivation for its sample; how even slices are is all that depends on it.
        """
        at = lambda df, s, e: df.select(*self.keys, F.explode(F.array(s, e)).alias("__at"))
        every = reduce(DataFrame.unionByName, (at(*t) for t in tables))
        return replace(self, bounds=every.filter(F.col("__at").isNotNull()))

    @property
    def found(self) -> bool:
        return self.listed is not None

    def regular(self, df: DataFrame) -> DataFrame:
        """Rows of keys that fit one task."""
        if not self.found:
            return df
        small = F.broadcast(self.listed)
        return df.join(small, same_keys(df, small, self.keys, "__k_"), "left_anti")

    def hot(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys."""
        small = F.broadcast(self.listed)
        return df.join(small, same_keys(df, small, self.keys, "__k_"), "left_semi")

    def cuts(
        self,
        df: DataFrame,
        *order: Column,
        rows: int | None = None,
        place: Column | None = None,
        bins: int = 1,
        max_cuts: int | None = None,
    ) -> Cuts:
        """Cut the hot keys at quantiles of ``order`` over the rows of ``df``, about ``rows`` rows to a slice.

        One job over a sample of hot rows, a fixed number per cut. Slices of ``bins`` times as many rows are
        divided into bins, where there is a ``place``, which keeps the cuts few. Beyond ``max_cuts`` slices
        grow, and their bins become more. A key that fits one slice is left whole.
        """
        if max_cuts is None:
            max_cuts = MAX_CUTS if place is None or bins == 1 else MAX_BINNED_CUTS
        rows = rows or max(LEAST_SLICE, self.hot_rows // SLICE_FACTOR)
        per_slice = max(rows if place is None else rows * bins, -(-self.total // max_cuts))
        n_bins = 1 if place is None else -(-per_slice // rows)
        fields = [f for f in self.listed.schema.fields if f.name != "__n"]
        large = [tuple(r[:-1]) for r in self.counts if r["__n"] > per_slice]
        if not large:
            none = _constant([], "array<int>")
            return Cuts(self.keys, None, self.listed, _uncut(0), 0, none, none, none, none, n_bins)
        kept = [F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)]
        kept += [c.alias(f"c{i}") for i, c in enumerate(order)]
        names = [f"k{i}" for i in range(len(self.keys))]
        orders = [f"c{i}" for i in range(len(order))]
        at = F.lit(None) if place is None else place
        picked = self.hot(df)
        if len(large) < len(self.counts):
            some = F.broadcast(df.sparkSession.createDataFrame(large, T.StructType(fields)))
            picked = df.join(some, same_keys(df, some, self.keys, "__k_"), "left_semi")
        share = min(1.0, SAMPLED / per_slice)
        if share < 0.5:
            picked = picked.sample(share, seed=7)
        else:
            share = 1.0
        picked = picked.select(*kept, at.cast("long").alias("p"))
        # Neighbouring cuts stand ``step`` sampled rows apart; the first and the last row are cuts as well.
        step = max(1, round(per_slice * share))
        last = F.size("seen") - 1
        chosen = (
            picked.groupBy(*names)
            .agg(F.sort_array(F.collect_list(F.struct(*orders, "p"))).alias("seen"))
            .select(
                *names,
                F.array_distinct(
                    F.concat(
                        F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.get("seen", i)),
                        F.array(F.get("seen", last)),
                    )
                ).alias("cuts"),
            )
            .withColumns(
                {
                    # Far-away values share the outer buckets.
                    "lo": F.get("cuts.p", F.floor(F.size("cuts") * 0.02).cast("int")).cast("double"),
                    "hi": F.get("cuts.p", F.floor(F.size("cuts") * 0.98).cast("int")).cast("double"),
                    "width": F.size("cuts") * BUCKETS if place is not None else F.lit(1),
                }
            )
            .withColumn(
                "buckets",
                F.transform("cuts", lambda c: _bucket(c["p"], F.col("lo"), F.col("hi"), F.col("width"))),
            )
        )
        shape = ["lo", "hi", "width", "buckets"]
        together = chosen.agg(F.collect_list(F.struct(*names, "cuts", *shape)).alias("all"))
        # All in one order: a key's cuts stand together.
        every = F.flatten(F.col("all.cuts"))
        whole = F.transform(every, lambda c: F.struct(*[c[o].alias(o) for o in orders]))
        row = together.select(
            F.transform("all", lambda k: F.struct(*[k[n].alias(n) for n in [*names, *shape]])).alias("keys"),
            F.to_json(whole, _FORMATS).alias("whole"),
            F.to_json(F.transform(every, lambda c: c["p"])).alias("edges"),
        ).first()
        kind = together.schema["all"].dataType.elementType["cuts"].dataType.elementType
        all_of = T.ArrayType(T.StructType([f for f in kind.fields if f.name != "p"]))
        places, at, before, inside, most = [], 0, [], [], 0
        for *key, lo, hi, width, buckets in row["keys"]:
            places.append((*key, (at, len(buckets), len(before), lo, hi, width)))
            counts = [0] * (width + 2)
            for b in buckets:
                counts[b] += 1
            before += [0, *accumulate(counts)][:-1]
            inside += counts
            at, most = at + len(buckets), max(most, len(buckets))
        # The place of keys without a cut: those of one slice, and any that the sample missed.
        uncut = _uncut(len(before))
        before, inside = [*before, 0, 0, 0], [*inside, 0, 0, 0]
        found = T.StructType(
            [T.StructField(n, T.IntegerType()) for n in ("at", "n", "lut")]
            + [T.StructField(n, T.DoubleType()) for n in ("lo", "hi")]
            + [T.StructField("width", T.LongType())]
        )
        return Cuts(
            self.keys,
            df.sparkSession.createDataFrame(places, T.StructType([*fields, T.StructField("__cut", found)])),
            self.listed if len(places) < len(self.counts) else None,
            uncut,
            most,
            F.from_json(F.lit(row["whole"] or "[]"), all_of, _FORMATS),
            _constant(before, "array<int>"),
            _constant(inside, "array<int>"),
            F.from_json(F.lit(row["edges"] or "[]"), "array<bigint>"),
            n_bins,
        )


def find_hot_keys(
    parts: list[DataFrame],
    keys: list[str],
    hot_rows: int | None | HotKeys,
    max_hot: int = MAX_HOT_KEYS,
) -> HotKeys:
    """Count rows per key over ``parts``.

    One job: a scan of the key columns with map-side partial counts.
    ``hot_rows=None`` skips it and declares that no key is hot. A ``HotKeys``
    from an earlier count is used as it is, which saves the job when several
    operators work on the same keys; counts of an input stand in for counts of
    what is derived from it.
    """
    if isinstance(hot_rows, HotKeys):
        if hot_rows.keys != list(keys):
            raise ValueError(f"hot keys were counted by {hot_rows.keys}, not by {list(keys)}")
        return hot_rows
    if hot_rows is None:
        return HotKeys(list(keys))
    if hot_rows < 1 or max_hot < 1:
        raise ValueError("hot_rows and max_hot must be positive")
    named = [p.select(*[F.col(k).alias(f"__k_{k}") for k in keys]) for p in parts]
    stats = (
        reduce(DataFrame.unionByName, named)
        .groupBy(*[f"__k_{k}" for k in keys])
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > hot_rows)
    )
    # The largest are told apart in a task: the driver gets no more than ``max_hot`` rows.
    largest = stats.orderBy(F.col("__n").desc()).limit(max_hot).repartition(1).collect()
    if not largest:
        return HotKeys(list(keys), hot_rows)
    listed = stats.sparkSession.createDataFrame(largest, stats.schema)
    return HotKeys(list(keys), hot_rows, listed, sum(r["__n"] for r in largest), counts=tuple(largest))


def both_paths(regular: DataFrame, sliced: DataFrame | None) -> DataFrame:
    """Union of the two paths' results."""
    return regular if sliced is None else regular.unionByName(sliced)
