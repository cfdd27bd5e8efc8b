"""Rows that wait until a reference table reaches them: each refresh of the reference decides those it covers, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Decide = Callable[[DataFrame, DataFrame], DataFrame]


def settled(spark: SparkSession, waiting: DataFrame, refreshes: str, schema: T.StructType, decide: Decide, place: str, files: int = 1) -> tuple[DataFrame, DataFrame]:
    """(decided, pending) after all files of the reference under ``refreshes``, ``files`` at a time in order of their writing.

    ``decide`` takes the pending rows and the reference as far as it is known, and returns the rows with a column ``verdict``, null for those that still wait. Decided rows are
    appended with the number of their refresh and never looked at again; the others are the next refresh's pending table. A refresh that runs again after a
    failure reads the pending table that it read before and replaces its own output; a later call with the same ``place`` reads new files only, and ``waiting`` counts in the first
    call alone.
    """
    first = f"{place}/pending/refresh=-1"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        waiting.write.mode("overwrite").parquet(first)
    kind = waiting.schema

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{place}/reference/refresh={number}")
        known = own.read.schema(schema).parquet(*(f"{place}/reference/refresh={n}" for n in range(number + 1)))
        told = decide(own.read.schema(kind).parquet(f"{place}/pending/refresh={number - 1}"), known)
        told.write.mode("overwrite").parquet(f"{place}/told/refresh={number}")  # the verdicts are found once
        told = own.read.schema(told.schema).parquet(f"{place}/told/refresh={number}")
        told.where("verdict is not null").write.mode("overwrite").parquet(f"{place}/decided/refresh={number}")
        told.where("verdict is null").select(kind.names).write.mode("overwrite").parquet(f"{place}/pending/refresh={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(refreshes)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(f.getPath().getName().rpartition("=")[2]) for f in store.listStatus(at.getParent().getParent()))
    decided = spark.read.parquet(f"{place}/decided") if last >= 0 else waiting.limit(0).select("*", F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("refresh"))
    return decided, spark.read.schema(kind).parquet(f"{place}/pending/refresh={last}")
