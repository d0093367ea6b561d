"""Places of regular expressions in texts, with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,`end`:int,value:string>>"


def spans(text: Column, pattern: str | Column, possible: Column | None = None) -> Column:
    """Leftmost matches that do not overlap, as structs of start, end (exclusive) and value, in code points.

    Splitting by the pattern gives what lies between the matches, so the places follow by adding
    up lengths.  The pattern must not match the empty string.  ``possible`` is a cheap necessary
    condition that spares most texts the search.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("all"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    def places(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(between, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["all"])).otherwise(
            F.array().cast(SPAN)
        )

    # The matches are bound by a lambda, so that they are searched once though used in several places.
    every = F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), places)[0]
    if possible is None:
        return every
    return F.when(possible, every).otherwise(F.array().cast(SPAN))
