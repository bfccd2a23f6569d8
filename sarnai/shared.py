"""Tables between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a local session gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_sarnai_folder", None) or f"file://{tempfile.mkdtemp(prefix='sarnai-')}"
        spark.sparkContext._sarnai_folder = folder  # the setting itself cannot be changed in a running session
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, name: str | None = None) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back, so that later steps neither compute them again
    nor depend on executors that may be lost. With a name the folder is named so, and ``written`` finds it."""
    spark = df.sparkSession
    to = f"{shared_folder(spark)}/{tag}-{name or uuid.uuid4().hex}"
    df.write.mode("overwrite" if name else "errorifexists").parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._sarnai_folder = to
    return out


def written(spark: SparkSession, tag: str, name: str | None) -> DataFrame | None:
    """The table materialized under that name, if all of it was written."""
    at = f"{shared_folder(spark)}/{tag}-{name}"
    if name is None or not _file_system(spark, at).exists(_path(spark, f"{at}/_SUCCESS")):
        return None
    return spark.read.parquet(at)


def discard(df: DataFrame) -> None:
    """Remove the folder of a materialized table that nothing will read again."""
    spark, at = df.sparkSession, df._sarnai_folder
    _file_system(spark, at).delete(_path(spark, at), True)


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _file_system(spark: SparkSession, at: str):
    return _path(spark, at).getFileSystem(spark._jsc.hadoopConfiguration())
