"""Writers, and the schema rule of the row-to-Parquet path."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPRESSION = {"none": "none", "gzip": "gzip", "zstd": "zstd"}


def write_dataset(df: DataFrame, path: str, order_col: str | None = None, compression: str = "none", dry_run: bool = False, mode: str = "overwrite") -> bool:
    """``.parquet`` writes Parquet, anything else JSON lines. With an order column the files hold
    ranges of it in order. ``dry_run`` writes nothing."""
    if compression not in COMPRESSION:
        raise ValueError(f"unknown compression {compression!r}")
    if dry_run:
        return False
    if order_col:
        df = df.orderBy(order_col)
    out = df.write.mode(mode).option("compression", COMPRESSION[compression])
    out.parquet(path) if PurePosixPath(path).suffix == ".parquet" else out.json(path)
    return True


def removed_path(output: str) -> str:
    p = PurePosixPath(output)
    return str(p.with_name(f"{p.stem}.removed.jsonl"))


def infer_schema(records: DataFrame, value: str = "value") -> T.StructType:
    """Field kinds of JSON objects: any string, array or object makes text; only floats double,
    only integers long, only booleans boolean; mixed numbers or nothing but nulls make text."""
    v = records.select(F.expr(f"try_parse_json({value})").alias("v"))
    pairs = v.where("schema_of_variant(v) like 'OBJECT%'").select(F.explode(F.expr("cast(v as map<string, variant>)")).alias("k", "x"))
    kind = F.expr("schema_of_variant(x)")
    kinds = pairs.groupBy("k").agg(
        F.max(kind.rlike("^(STRING|ARRAY|OBJECT)").cast("int")).alias("text"),
        F.max(kind.rlike("^(DOUBLE|DECIMAL|FLOAT)").cast("int")).alias("float"),
        F.max(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)").cast("int")).alias("int"),
        F.max((kind == "BOOLEAN").cast("int")).alias("bool"),
    )

    def of(r) -> T.DataType:
        one = {"float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType()}
        on = [k for k in one if r[k]]
        return one[on[0]] if not r["text"] and len(on) == 1 else T.StringType()

    return T.StructType([T.StructField(r["k"], of(r), True) for r in sorted(kinds.collect(), key=lambda r: r["k"])])
