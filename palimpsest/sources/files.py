"""Readers: delimited text with every column a string, JSON lines, JSON maps, and framed block files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

POINTER = "version https://git-lfs.github.com/spec/v1"


def read_text_table(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """A CSV or TSV as strings: the header is read first, so a missing column reads as empty and a required order is no matter."""
    found = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    pick = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in found.columns else F.lit("")
    return found.select(*(pick(c).alias(c) for c in columns), F.col("_metadata.file_path").alias("source_path"))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df


def refuse_pointers(spark: SparkSession, path: str) -> None:
    """A large-file pointer in place of data is an error."""
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].startswith(POINTER):
        raise ValueError(f"{path} is a pointer to data, not data")


def read_json_blocks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Decoded blocks as JSON lines (gzip too); lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_parents(spark: SparkSession, path: str, schema: T.StructType, parent: str) -> DataFrame:
    """Decoded blocks as JSON lines, of those that name one parent the first: in order of file names, places in a file, and lines. Blocks without a parent go."""
    rows = read_json_blocks(spark, path, schema).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("_order"))
    names = [c for c in rows.columns if c != "_order"]
    first = rows.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.min_by(F.struct(*names), "_order").alias("_first"))
    return first.select("_first.*")


def read_json_list(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects of files that hold one JSON list each; a file that holds none fails the read."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"}).alias("rows"))
    return rows.select(F.explode("rows").alias("row")).select("row.*")


def read_cache(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(key, state, detail) of JSON maps whose values are true or an object (``present``, the object's text as ``detail``), false (``absent``), or null (``unknown``). Any
    other value fails the read."""
    rows = read_json_map(spark, path)
    state = F.when(F.col("value").isNull() | (F.col("value") == "null"), "unknown").when(F.col("value") == "false", "absent").when((F.col("value") == "true") | F.col("value").startswith("{"), "present")
    checked = F.coalesce(state, F.raise_error(F.lit("a cache holds a value that is neither true, false, an object nor null")).cast("string"))
    return rows.select("key", checked.alias("state"), F.when(F.col("value").startswith("{"), F.col("value")).alias("detail"))


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """(hash, size) of a census of markers: hashes of 32 bytes in internal order, each once; a null size is a block without a marker. A row that breaks this fails the query."""
    rows = spark.read.schema("hash binary, size bigint").parquet(path)
    one = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    good = (F.octet_length("hash") == 32) & (F.col("n") == 1)
    return one.select(F.when(F.coalesce(good, F.lit(False)), F.col("hash")).otherwise(F.raise_error(F.lit("a census row has no hash of its own")).cast("binary")).alias("hash"), "size")


def in_census(rows: DataFrame, census: DataFrame) -> DataFrame:
    """``rows`` (hash as it is shown, and more) with ``state`` (present, absent, not found) and the marker's ``size``."""
    shown = census.select(F.regexp_replace(F.reverse(F.lower(F.hex("hash"))), "(.)(.)", "$2$1").alias("_shown"), "size", F.lit(True).alias("_found"))
    state = F.when(F.col("_found").isNull(), "not found").when(F.col("size").isNull(), "absent").otherwise("present")
    return rows.join(shown, F.lower("hash") == F.col("_shown"), "left").withColumn("state", state).drop("_shown", "_found")


def write_block_files(blocks: DataFrame, folder: str) -> int:
    """A file block_<height>.bin for each row (height, content) of ``blocks``, written by the tasks; how many."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for height, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with target.open_output_stream(f"{place}/block_{height}.bin") as out:
                    out.write(content)
            yield batch.select([0])

    return blocks.select(F.col("height").cast("bigint"), "content").mapInArrow(put, "height bigint").count()


def block_files(spark: SparkSession, path: str, pattern: str = r"block_(\d+)\.bin$") -> DataFrame:
    """(height, content) of files that hold one block each and have its height in their name; another name fails the read, as does a height that stands twice."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", pattern, 1).alias("height"), "content")
    height = F.when(F.col("height") == "", F.raise_error(F.lit("a file's name has no height")).cast("bigint")).otherwise(F.col("height").cast("bigint"))
    one = found.withColumn("height", height).groupBy("height").agg(F.count(F.lit(1)).alias("n"), F.first("content").alias("content"))
    return one.select(F.when(F.col("n") > 1, F.raise_error(F.lit("two files have one height")).cast("bigint")).otherwise(F.col("height")).alias("height"), "content")


def read_json_map(spark: SparkSession, path: str | list[str], key: Column | None = None) -> DataFrame:
    """(key, value) of files that hold one JSON object each; of equal keys the file that sorts last wins."""
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = text.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("key").agg(F.max_by(F.struct("value"), "file")["value"].alias("value"))


FRAMES = "path string, number int, offset long, block binary"


def masked(data: bytes, mask: bytes) -> bytes:
    """``data`` XORed with ``mask`` over and over from offset 0; twice gives ``data`` again."""
    pad = np.resize(np.frombuffer(mask, np.uint8), len(data)) if data else np.zeros(0, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ pad).tobytes()


def unmasked(content: str, mask: bytes) -> Column:
    return pandas_udf(lambda s: s.map(lambda x: None if x is None else masked(bytes(x), mask)), T.BinaryType())(content)


#: Bytes of the largest frame, unless the caller names another size.
MOST_BLOCK = 8_000_000


def split_frames(data: bytes, magic: bytes, mask: bytes = b"", most: int = MOST_BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of frames: magic, little-endian size, payload. Noise is skipped up to the next magic. A frame
    that is cut short by the end of the file ends it, as a file may still be written; a size out of range is an error."""
    if mask:
        data = masked(data, mask)
    at = data.find(magic)
    while at >= 0:
        start = at + len(magic) + 4
        if start > len(data):
            return
        size = int.from_bytes(data[start - 4 : start], "little")
        if not 0 < size <= most:
            raise ValueError(f"the frame at {at} has a size of {size}")
        if start + size > len(data):
            return
        yield at, data[start : start + size]
        at = data.find(magic, start + size)


def frames(files: DataFrame, magic: bytes, mask: bytes = b"", most: int = MOST_BLOCK) -> DataFrame:
    """The blocks of a binaryFile table (path, content); one file is one row, so a task holds one file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, i, at, block) for i, (at, block) in enumerate(split_frames(bytes(content), magic, mask, most))]
                yield pd.DataFrame(rows, columns=["path", "number", "offset", "block"])

    return files.select("path", "content").mapInPandas(run, FRAMES)


def best_source(catalogue: DataFrame) -> DataFrame:
    """Of each chain's sources (chain, precedence, path) the one that comes first."""
    return catalogue.groupBy("chain").agg(F.min_by("path", "precedence").alias("path"), F.min("precedence").alias("precedence"))


def authenticated(read: DataFrame, index: DataFrame, failures: DataFrame) -> DataFrame:
    """``index`` (height, txid, ...) with the state of each height: read, or a documented failure. A height that is read but not in
    the index, missing without a document, or read with another txid fails the query."""
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    r = read.select("height", F.col("txid").alias("_read"))
    f = failures.select("height", F.lit(True).alias("_failed")).distinct()
    joined = index.withColumn("_known", F.lit(True)).join(r, "height", "full_outer").join(f, "height", "full_outer")
    state = (
        F.when(F.col("_known").isNull(), fail("a height isn't in the index"))
        .when(F.col("_read").isNotNull() & F.col("_failed"), fail("a height is read and documented as missing"))
        .when(F.col("_read").isNotNull() & (F.col("_read") != F.col("txid")), fail("a file has another txid than the index"))
        .when(F.col("_read").isNotNull(), F.lit("read"))
        .when(F.col("_failed"), F.lit("documented failure"))
        .otherwise(fail("a height is missing"))
    )
    return joined.withColumn("state", state).drop("_read", "_failed", "_known")


def builder_rows(rows: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """``rows`` with the array of their ``chains``: at least one, all different, each with a known prefix; else the read fails."""
    chains = F.split("source_chains", "\\|")
    known = F.forall(chains, lambda c: F.array_contains(F.transform(F.array(*map(F.lit, prefixes)), lambda p: c.startswith(p)), True))
    good = (F.size(chains) > 0) & (F.size(F.array_distinct(chains)) == F.size(chains)) & known
    return rows.withColumn("chains", F.when(good, chains).otherwise(F.raise_error(F.lit("a row's chains are malformed")).cast("array<string>")))
