"""Incremental header ingestion: a checkpointed stream that keeps the tip of every chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settings import held


def chain_tips(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, out: str, files: int = 4) -> DataFrame:
    """(chain, n, tip_height, tip_hash) after all files under ``source``, some at a time. Of headers at one height the first that was seen is the tip: the
    one with the smallest ``place``, a column of the files.

    Each batch writes the chains that it changed; a batch that is run again after a failure replaces its own output,
    and a later call with the same checkpoint reads new files only.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    tips = stream.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("height", (-F.col("place")).alias("seen"), "hash")).alias("tip"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with held(spark):
        tips.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(out)
    return told.groupBy("chain").agg(F.max_by("n", "batch").alias("n"), F.max_by("tip", "batch").alias("tip")).select("chain", "n", F.col("tip.height").alias("tip_height"), F.col("tip.hash").alias("tip_hash"))
