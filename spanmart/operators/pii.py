"""Salted hashing of columns tagged as sensitive.

A tag is a true flag in a column's metadata; Spark keeps it through select,
filter and Parquet. The salt is a secret: pass it in, or set the environment
variable ``PII_SALT`` on the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_salt() -> str:
    salt = os.environ.get("PII_SALT")
    if salt is None:
        raise ValueError("pass a salt or set PII_SALT")
    return salt


def tag_columns(df: DataFrame, cols: list[str], key: str = "sensitive") -> DataFrame:
    """Set a metadata flag on columns, keeping what metadata they have."""
    for col in cols:
        df = df.withMetadata(col, {**df.schema[col].metadata, key: True})
    return df


def columns_with_meta(df: DataFrame, key: str | None = None) -> list[str]:
    """Columns whose metadata flag ``key`` is true; without a key, all documented columns."""
    if key is None:
        return [f.name for f in df.schema.fields if f.metadata]
    return [f.name for f in df.schema.fields if f.metadata.get(key) is True]


def hash_column(col: str, salt: str | None = None, rename: bool = True) -> Column:
    """sha2-256 of the salted text, lower-cased and trimmed after salting; NULL stays NULL."""
    salted = F.concat(F.col(col).cast("string"), F.lit(get_salt() if salt is None else salt))
    hashed = F.sha2(F.trim(F.lower(salted)), 256)
    return hashed.alias(f"{col.lower()}_hash") if rename else hashed


def hash_sensitive_columns(
    df: DataFrame, meta_key: str = "sensitive", salt: str | None = None
) -> DataFrame:
    """Tagged columns as hashes first, then the other columns unchanged."""
    tagged = columns_with_meta(df, meta_key)
    others = [c for c in df.columns if c not in tagged]
    if not others:
        raise ValueError("no columns are left beside the hashed ones")
    return df.select(*[hash_column(c, salt) for c in tagged], *others)


def nohash_sensitive_columns(
    df: DataFrame, join_key: str | None = None, salt: str | None = None
) -> DataFrame:
    """Tagged columns in clear, with the hashed join key that links both halves."""
    key = [] if join_key is None else [hash_column(join_key, salt)]
    return df.select(*key, *columns_with_meta(df, "sensitive"))
