"""Intermediate tables in the folder that driver and executors share: written, named, deleted."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A session on one machine that names none, as in tests, gets one of its
    own; on a cluster that is an error, as a local folder would be another one on each machine."""
    told = spark.conf.get(SETTING, None)
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        told = Path(tempfile.mkdtemp(prefix="palimpsest-")).as_uri()
        spark.conf.set(SETTING, told)
    return told.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def whole_path(spark: SparkSession, path: str) -> str:
    """``path`` as Spark tells of the files in it: with the scheme and host of its file system, which ``path`` may lack, and no slash at the end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and survives lost executors. Text in hex takes half as much with ``zstd``."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any longer. Spark removes the shuffle files of a plan once the
    driver has collected it, so that is asked for as well."""
    for table in tables:
        delete(table.sparkSession, table.written_at)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()
