"""Text, money and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmart.functions.dates import as_col


def string_to_array(
    col: Column | str,
    left: str = '["',
    right: str = '"]',
    sep: str = '","',
    empty: str = "[]",
) -> Column:
    """Array-like text → array of strings.

    ``left`` and ``right`` are sets of characters to strip, not whole strings;
    ``sep`` is a regular expression. The ``empty`` text gives an empty array.
    """
    col = as_col(col)
    body = F.ltrim(F.rtrim(col, F.lit(right)), F.lit(left))
    return F.when(col == F.lit(empty), F.array().cast("array<string>")).otherwise(
        F.split(body, sep)
    )


def nullify_empty_strings(col: str | Column, alias: str | None = None) -> Column:
    """'' → NULL. A plain column name keeps its name unless ``alias`` is given."""
    name = alias or (col if isinstance(col, str) else None)
    out = F.nullif(as_col(col), F.lit(""))
    return out.alias(name) if name else out


def cents_to_dollars(col: Column | str) -> Column:
    """Hundredths of a unit → decimal(16,2), rounded half up."""
    return (as_col(col) / F.lit(100)).cast("decimal(16,2)")


def parse_json_map(col: Column | str) -> Column:
    """JSON object text → map<string,string>; malformed text → NULL."""
    return F.from_json(as_col(col), "map<string,string>")


def json_map_key(col: Column | str, key: str) -> Column:
    """One entry of a JSON object held as text; nested values stay JSON text."""
    return F.element_at(parse_json_map(col), F.lit(key))


def map_lookup(col: Column | str, key: str) -> Column:
    """Map entry, NULL when the key is missing."""
    return F.element_at(as_col(col), F.lit(key))


def struct_field(col: str, field: str) -> Column:
    return F.col(col).getField(field)


def safe_cast(col: Column | str, dtype: str) -> Column:
    """Cast that yields NULL instead of an error."""
    return as_col(col).try_cast(dtype)
