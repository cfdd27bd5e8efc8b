"""Exact deduplication with keyed streaming state, in DataFrame operations only.

1. A digest log is written: SHA-256 of each normalised text, doc_id, length and locator (file and row in it).
2. A Structured Streaming aggregation reads the log. Its state is kept by digest in RocksDB on the executors'
   disks, checkpointed to the shared folder, without watermark, so that no key expires: the smallest doc_id,
   its locator, and the number of rows. Partial aggregation runs before the shuffle: a hot group costs
   one row per task.
3. Hits are checked: the text of the row that stays is fetched by its locator, from the table of this call or of an earlier one,
   and compared byte by byte with each copy. A large group is spread over many tasks, each with the row that stays.
   Rows that differ despite one digest are grouped by the text itself.

A later call with the same folder goes on from the state; it returns the rows of its own table, and counts and compares them with
those of all calls before.

Defined results: a null text counts as empty. White space runs count as one space. Rows that repeat a doc_id count
as rows of their own. A null doc_id sorts after all others and is compared like any other row. Of rows that repeat the smallest
doc_id, that of the first file and row stays. A text may be of any length that a Spark string may have. An empty table gives no
rows. Other columns, whatever their names, are ignored by ``dedup`` and passed on by ``keep_first``. A table that isn't read from
Parquet files is written to the shared folder first, as it has no locators.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACES, by_place, checked, drop, fresh_path, text_or_empty, written

ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # a store is closed once its version is saved: open stores of all partitions would fill an executor's disk
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
PLACE = ["file", "row"]
#: So many copies of one text are compared in a task.
SPREAD = 200


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def digest(col: str) -> Column:
    return F.unhex(F.sha2(col, 256))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the row that hold each row."""
    return docs.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})


def from_files(docs: DataFrame) -> DataFrame:
    try:
        placed(docs.select("doc_id"))
        return docs
    except AnalysisException:
        return written(docs, "documents")


def log_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("bytes", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def digest_log(docs: DataFrame, path: str) -> DataFrame:
    """Written: doc_id, digest, bytes of the normalised text, and the locator of the content."""
    text = placed(docs.select("doc_id", "text")).select("doc_id", *PLACE, normalised().alias("norm"))
    text.select("doc_id", digest("norm").alias("digest"), F.octet_length("norm").alias("bytes"), *PLACE).write.parquet(path)
    return docs.sparkSession.read.schema(log_schema(docs)).parquet(path)


def keyed_state(spark: SparkSession, log: str, schema: T.StructType, checkpoint: str, out: str) -> DataFrame:
    """Brings the state up to date with the log and returns it: digest, keep_id, keep_file, keep_row, group_size.

    A later call with the same checkpoint and out continues from the state: only new files of the log are read.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).parquet(f"{log}/*")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *PLACE))
        state = stream.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))

        def put(batch: DataFrame, number: int) -> None:
            batch.select("digest", "first", "group_size").write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    kept = T.StructType([T.StructField("last", T.BooleanType()), schema["doc_id"], schema["file"], schema["row"]])
    told = spark.read.schema(T.StructType([schema["digest"], T.StructField("first", kept), T.StructField("group_size", T.LongType()), T.StructField("batch", T.LongType())])).parquet(out)
    # the state only grows, so the least first row and the largest count are those of the last batch
    told = told.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))
    return told.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"), "group_size")


def as_path(uri: str) -> str:
    """A file's URI, in which Spark tells where rows are from, as a path that the reader takes literally: percent signs are decoded, and what a
    pattern would read otherwise is escaped."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(uri))


def texts_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, row, and more) with the normalised text that each holds. Files of earlier calls are read by name; their
    names reach the driver, as those of any scan do."""
    here = placed(docs.select("text"))
    own = {r["file"] for r in here.select("file").distinct().collect()}
    other = [r["file"] for r in places.select("file").distinct().collect() if r["file"] not in own]
    if other:
        here = here.unionByName(placed(docs.sparkSession.read.schema(T.StructType([docs.schema["text"]])).parquet(*map(as_path, other))))
    return here.join(checked(places), PLACE).withColumn("norm", normalised()).drop("text")


def false_hits(docs: DataFrame, log: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest) of ``groups`` under which texts differ: every row of ``log`` in a group is compared with the one that stays, whole."""
    spread = F.ceil(F.col("group_size") / SPREAD).cast("long")
    members = log.join(checked(groups), "digest").where(~(F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))))
    copies = members.select(*PLACE, "digest", F.pmod(F.xxhash64(*PLACE), spread).alias("salt"))
    hit = members.select("digest").distinct()
    keepers = groups.join(checked(hit), "digest", "left_semi").select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row"), "digest", F.sequence(F.lit(0).cast("long"), spread - 1).alias("salts"))
    copies, keepers = written(copies, "hits"), written(keepers, "keepers")
    told = texts_at(docs, keepers).select("digest", F.explode("salts").alias("salt"), F.col("norm").alias("keep_norm"))
    differ = texts_at(docs, copies).join(told, ["digest", "salt"]).where("norm <> keep_norm").select("digest").distinct()
    out = written(differ, "differ")
    drop(copies, keepers)
    return out


def dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row: one row per row of ``docs``."""
    spark, docs = docs.sparkSession, from_files(by_place(docs, "doc_id", "text"))
    folder = folder or fresh_path(spark, "dedup")
    log = digest_log(docs, f"{folder}/log/{uuid.uuid4().hex}")
    if log.isEmpty():
        return log.selectExpr("doc_id", "doc_id as keep_id", "1L as group_size", "true as kept", "lower(hex(digest)) as text_sha256", *PLACE)
    groups = keyed_state(spark, f"{folder}/log", log.schema, f"{folder}/checkpoint", f"{folder}/state").where("group_size > 1")
    is_kept = F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))
    out = log.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | is_kept).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *PLACE,
        "digest",
    )
    differ = false_hits(docs, log, groups)
    if not differ.isEmpty():  # one digest, several texts: these rows are grouped by their text
        everywhere = spark.read.schema(log.schema).parquet(f"{folder}/log/*")
        rows = written(texts_at(docs, everywhere.join(differ, "digest", "left_semi").drop("bytes")), "differing")
        by_text = rows.groupBy("norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *PLACE)).alias("f"), F.count(F.lit(1)).alias("group_size"))
        again = rows.join(log.select(*PLACE), PLACE, "left_semi").join(by_text, "norm")
        again = again.selectExpr("doc_id", "f.doc_id as keep_id", "group_size", "file <=> f.file and row <=> f.row as kept", "lower(hex(digest)) as text_sha256", *PLACE, "digest")
        out = out.join(differ, "digest", "left_anti").unionByName(again)
    return out.drop("digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = docs.columns
    docs = from_files(by_place(docs, "doc_id", "text"))
    gone = written(dedup(docs).where("not kept").select(F.struct(*PLACE).alias("place")), "gone")
    at = docs.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return at.join(checked(gone), "place", "left_anti").select(docs.columns).toDF(*names)
