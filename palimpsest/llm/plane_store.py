"""Token ids in a binary file format of bit planes or byte planes.

Documents are sorted by doc_id over range partitions; each partition is a shard of chunks of whole documents.
The ids of a chunk are cut into blocks of a fixed size; a block is transposed into planes (the lowest bit or byte of
every id first), and each plane is a zstandard frame of its own. The chunk index tells, for every chunk, its
documents' lengths, the sizes of the planes and where its ids begin in the whole corpus. Chunks are rows of
Parquet, so that any store that Spark writes will do and a task that is run again replaces its own output.

Defined results: a null text is empty and has the end id only. A null doc_id sorts first. Rows that repeat a
doc_id are stored one after the other. A text may be of any length; its ids are in one chunk. An empty table gives a store without chunks.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_bytes, slices, small_batches
from .word_tokens import encoder_of, with_end

BLOCK, BLOCKS_PER_CHUNK = 65_536, 4


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, without those above its highest id."""
    n = len(ids)
    octets = ids.astype("<u4").view(np.uint8).reshape(n, 4)
    width = max(1, int(ids.max()).bit_length()) if n else 1
    if not bits:
        return [octets[:, k].tobytes() for k in range((width + 7) // 8)]
    columns = [np.ascontiguousarray(octets[:, k]) for k in range((width + 7) // 8)]
    return [np.packbits(columns[k // 8] & (1 << k % 8), bitorder="little").tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
        return octets.reshape(-1).view("<u4")
    for k in range(0, len(planes), 8):
        column = np.zeros(n, np.uint8)
        for j, p in enumerate(planes[k : k + 8]):
            column |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << np.uint8(j)
        octets[:, k // 8] = column
    return octets.reshape(-1).view("<u4")


def _chunk(ids: np.ndarray, block: int, bits: bool, level: int) -> tuple[list[int], bytes]:
    """Sizes of the frames, a negative plane count before those of each block, and the frames."""
    squeeze, sizes, frames = zstandard.ZstdCompressor(level=level), [], []
    for a in range(0, len(ids), block):
        planes = [squeeze.compress(p) for p in to_planes(ids[a : a + block], bits)]
        sizes += [-len(planes), *map(len, planes)]
        frames += planes
    return sizes, b"".join(frames)


def _unchunk(n: int, sizes: list[int], payload: bytes, block: int, bits: bool) -> np.ndarray:
    expand, at, i, out = zstandard.ZstdDecompressor(), 0, 0, []
    for a in range(0, n, block):
        planes = []
        for size in sizes[i + 1 : i + 1 - sizes[i]]:
            planes.append(expand.decompress(payload[at : at + size]))
            at += size
        i += 1 - sizes[i]
        out.append(from_planes(planes, min(block, n - a), bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, tokenizer: str, bits: bool = True, block: int = BLOCK, level: int = 1) -> None:
    """Writes ``path``/chunks and ``path``/index."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(held), "<u4")
            sizes, payload = _chunk(whole, block, bits, level)
            row = [[shard], [number], [len(whole)], [ids], [[len(x) // 4 for x in held]], [block], [bits], [sizes], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.binary()]
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                for doc, tokens in zip(part.column(0).to_pylist(), map(with_end, encoder.encode(texts)), strict=True):
                    ids.append(doc)
                    held.append(tokens)
                    size += len(tokens) // 4
                    if size >= block * BLOCKS_PER_CHUNK:
                        yield chunk()
                        ids, held, size, number = [], [], 0, number + 1
        if held:
            yield chunk()

    schema = f"shard int, chunk int, n_ids long, doc_ids array<{kind}>, lengths array<int>, block int, bits boolean, plane_sizes array<int>, planes binary"
    names = [x.split()[0] for x in schema.split(", ")]
    ordered = docs.select("doc_id", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/chunks")

    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"), F.col("doc_ids")[0].alias("first_doc"))
    shards, begin = [], 0
    for shard, n in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row per shard
        shards.append((shard, begin))
        begin += n
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spark.createDataFrame(shards, "shard int, begin long")
    index = chunks.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(offsets), "shard").select("shard", "chunk", "n_docs", "n_ids", "first_doc", (F.col("begin") + F.col("before")).alias("start"))
    index.write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each stored document."""
    chunks = spark.read.parquet(f"{path}/chunks")
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unchunk(row["n_ids"], row["plane_sizes"], row["planes"], row["block"], row["bits"])
                cuts = np.r_[0, np.cumsum(row["lengths"])]
                data = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                n = len(data)
                columns = [row["doc_ids"], [row["start"]] * n, cuts[:-1], row["lengths"], data]
                types = [batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "begin", "at", "n_tokens", "ids"])

    small_batches(spark)
    started = chunks.join(spark.read.parquet(f"{path}/index").select("shard", "chunk", "start"), ["shard", "chunk"])
    out = started.select("start", "n_ids", "doc_ids", "lengths", "block", "bits", "plane_sizes", "planes").mapInArrow(run, f"doc_id {kind}, begin long, at long, n_tokens long, ids binary")
    return out.select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files."""
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
