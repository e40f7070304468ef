"""The session and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (local tests) a temporary folder is made and set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomsieve-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; later plans start from those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cores: int | str = "*", name: str = "loomsieve", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {
        "spark.sql.shuffle.partitions": str(os.cpu_count() if cores == "*" else cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table: later plans read only the columns they use, know its size and
    inherit no constraints, which a checkpoint hands on and loops pile up."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
