"""Record identities. Hash values aren't contractual; equality of the hashed values is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_floats(kind: T.DataType, c: Column) -> Column:
    """NaN and infinities count as null inside a full record."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(~bad, c)
    return c


def record_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The whole record as JSON with its keys sorted, so that their order doesn't matter."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[clean_floats(df.schema[n].dataType, F.col(f"`{n}`")).alias(n) for n in names]))


def record_hash(df: DataFrame) -> Column:
    return F.xxhash64(record_json(df))


def record_md5(df: DataFrame, columns: list[str]) -> Column:
    """A portable digest: columns in name order, joined with 0x1F, nulls as 0x00."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]))


def string_hash(c: Column) -> Column:
    return F.xxhash64(c)
