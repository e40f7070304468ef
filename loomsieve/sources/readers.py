"""Datasets by file extension, with the row identity that dedup orders by."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsieve.functions.hashing import record_json

FORMATS = {"jsonl": "jsonl", "json": "jsonl", "gz": "jsonl", "parquet": "parquet", "csv": "csv"}


def format_of(path: str) -> str:
    """By the last extension, in exact case."""
    ext = PurePosixPath(str(path)).suffix[1:]
    if ext not in FORMATS:
        raise ValueError(f"unsupported format: {path}")
    return FORMATS[ext]


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines (gzip by extension), Parquet or CSV. Blank and malformed lines are skipped;
    unknown names among ``columns`` are ignored."""
    kind = format_of(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        df = reader.parquet(path)
    elif kind == "csv":
        df = reader.csv(path, header=True, mode="DROPMALFORMED")
    else:
        df = reader.option("mode", "DROPMALFORMED").json(path)
        if df.columns == ["_corrupt_record"]:
            df = df.drop("_corrupt_record")
    return project(df, columns)


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df if columns is None else df.select(*[f"`{c}`" for c in columns if c in df.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines as (source_line, value): 1-based, counting blank and malformed ones.
    ``value`` is a canonical VARIANT text, so key order doesn't matter and arrays stay records."""
    raw = with_row_id(spark.read.text(path), "source_line").withColumn("source_line", F.col("source_line") + 1)
    parsed = raw.withColumn("v", F.expr("try_parse_json(value)")).where("v is not null")
    return parsed.select("source_line", F.to_json("v").alias("value"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based arrival position: files by path, then place within the file.

    Partition counts are gathered in one small aggregate and added to each row's
    place, so nothing is sorted into one task.
    """
    spark = df.sparkSession
    tagged = df.withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    counts = tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    base = {r.p: r.base or 0 for r in base.collect()}  # one row a partition
    offsets = spark.createDataFrame(list(base.items()) or [(0, 0)], "p long, base long")
    return tagged.withColumn("p", part).join(F.broadcast(offsets), "p").select((F.col("base") + place).alias(name), *df.columns)


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def inspect(df: DataFrame, n: int = 10, order_col: str = "row_id") -> DataFrame:
    """The first n records in order, as JSON with sorted keys."""
    return df.orderBy(order_col).limit(n).select(F.col(order_col), record_json(df, [c for c in df.columns if c != order_col]).alias("record"))


def inspect_text(df: DataFrame, n: int = 10, order_col: str = "row_id") -> list[str]:
    """``Record #k`` blocks, pretty-printed."""
    names = sorted(c for c in df.columns if c != order_col)
    rows = df.orderBy(order_col).limit(n).select(F.to_json(F.struct(*names), {"pretty": "true"}).alias("r")).collect()
    return [f"Record #{k}: {row.r}" for k, row in enumerate(rows, 1)]
