"""Exact deduplication: the first record of each key, in a declared order, stays.

A combined minimum of order values rather than ``dropDuplicates``: the survivor is fixed
and null keys stay apart; rather than a window: no task sorts the rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions import hashing, text
from loomsieve.session import stored

STRATEGIES = ("full", "field", "normalized", "multi")


def key_column(df: DataFrame, strategy: str, fields: list[str] | None = None) -> Column:
    """The identity of a record under a strategy; null means always unique."""
    fields = fields or []
    if strategy == "full":
        return hashing.record_json(df)
    if strategy == "field":
        return text.field(df, fields[0])
    if strategy == "normalized":
        return text.fold_key(text.field(df, fields[0]))
    if strategy == "multi":
        present = [f for f in fields if f in df.columns]
        return F.to_json(F.struct(*[F.col(f"`{f}`").alias(f) for f in present]), {"ignoreNullFields": "false"}) if present else F.lit("{}")
    raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")


def choose_strategy(field: str | None, normalize: bool) -> str:
    """As on the command line: normalize alone is ignored."""
    return ("normalized" if normalize else "field") if field else "full"


def digest(key: Column) -> Column:
    return F.unhex(F.sha2(key.cast("string"), 256))


def repeated(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """(__d, __none, __first, __ties): the digest of each key that several records have, whether its first
    record has no order value and which one it has otherwise, and how many records share that. One pass
    over the key's columns, combined on the map side; only digests are shuffled. Null order values come
    last. The table is written out, so what follows knows its size."""
    keyed = df.select(digest(key).alias("__d"), F.col(order_col).alias("__o")).where("__d is not null")
    each = keyed.groupBy("__d", "__o").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("__o").isNull().alias("none"), F.col("__o").alias("o"), "n")).alias("f")
    keys = each.groupBy("__d").agg(first, F.sum("n").alias("n")).where("n > 1")
    return stored(keys.select("__d", F.col("f.none").alias("__none"), F.col("f.o").alias("__first"), F.col("f.n").alias("__ties")), "repeated-keys")


def mark_duplicates(df: DataFrame, key: Column, order_col: str, flag: str = "is_duplicate") -> DataFrame:
    """Adds a boolean: an earlier record (by ``order_col``, nulls last) has the same key. Records that tie
    for the first place all count as first."""
    keys = repeated(df, key, order_col)
    both = df.withColumn("__k", digest(key)).join(keys, F.col("__k") == F.col("__d"), "left")
    first = F.col("__d").isNull() | F.col(order_col).eqNullSafe(F.col("__first"))
    return both.withColumn(flag, ~first).select(*df.columns, flag)


def keep_first(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """The first record of each key by ``order_col``, nulls last; one of those that tie for the first
    place; every record without a key. Records meet only the keys that repeat: few of them are broadcast,
    by their written size, and adaptive execution splits a key that holds many rows."""
    keys = repeated(df, key, order_col)
    both = df.withColumn("__k", digest(key)).join(keys, F.col("__k") == F.col("__d"), "left")
    kept = both.where(F.col("__d").isNull() | F.col(order_col).eqNullSafe(F.col("__first")))
    if keys.where("__ties > 1").isEmpty():
        return kept.select(*df.columns)
    tied = F.coalesce(F.col("__ties") > 1, F.lit(False))
    return kept.where(~tied).select(*df.columns).unionByName(kept.where(tied).dropDuplicates(["__k"]).select(*df.columns))


def exact_dedup(df: DataFrame, strategy: str = "full", fields: list[str] | None = None, order_col: str = "row_id") -> DataFrame:
    """The first record of each key (see ``keep_first``)."""
    return keep_first(df, key_column(df, strategy, fields), order_col)


def dedup_by_hash(df: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """Keep-first on a hash that the caller computed; null is unique."""
    return keep_first(df, F.col(hash_col), order_col)


def dedup_stats(df: DataFrame, strategy: str, fields: list[str] | None = None) -> DataFrame:
    """One row: totals and the rate in percent (0 over nothing). Counts come from a
    map-side combined count by key, which holds for hot keys too."""
    keyed = df.select(key_column(df, strategy, fields).alias("k"))
    per_key = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = per_key.agg(total.cast("long").alias("total_seen"), kept.cast("long").alias("unique_count"), F.count("k").alias("distinct_keys"))
    dup = F.col("total_seen") - F.col("unique_count")
    return out.select(
        "total_seen",
        "unique_count",
        dup.alias("duplicates_found"),
        "distinct_keys",
        F.when(F.col("total_seen") > 0, F.round(dup * 100.0 / F.col("total_seen"), 6)).otherwise(0.0).alias("dedup_rate"),
    )
