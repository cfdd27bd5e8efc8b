"""A data source ``blkdat``: framed block files (magic, little-endian size, payload), read by ranges of bytes.

A file is dealt out in ranges; a frame belongs to the range in which it starts, so one that crosses a border is read once, and a file may be larger than a task.
Frames are found by going from one to the next from the start of the file: the search for the next magic from a border could take bytes
of a payload for a frame. Going over a frame before the range reads its eight bytes only, in windows of 64 KB.

Files lie where pyarrow's file systems reach (local folders that all machines mount, HDFS, S3, GCS). For stores that only Spark reads there is ``files.frames`` over a
``binaryFile`` table.

Options: ``path`` (a file, or a folder with blk<number>.dat), ``magic`` (hex), ``mask`` (hex, XORed from offset 0; by default what xor.dat beside the
files holds), ``rangeBytes``, ``taskBytes`` (ranges go to one task, one after another, up to so many bytes and a share of all, so that few ranges have tasks of their own; opening one counts as ``OPENING``), ``most`` (payload bytes of the largest frame), ``onBadFrame``: ``fail``, or ``stop`` to leave out the rest of the file. A
frame of no bytes, of more than ``most``, or that the file cuts short, is bad. Noise between frames is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import masked

SCHEMA = "path string, offset long, block binary"
WINDOW, BATCH = 1 << 16, 1 << 24
OPENING, TASK = 1 << 16, 1 << 25
#: Ranges share tasks only where there are more of them; so a small folder is read by many tasks as well.
SPREAD = 64
NUMBERED = re.compile(r"blk\d+\.dat$")
KEY_FILE = "xor.dat"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, mask: bytes) -> None:
        self.path, self.start, self.end, self.mask = path, start, end, mask


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def dealt(ranges: list[Range], most: int) -> list[Ranges]:
    """The ranges in their order, in as few tasks as ``most`` bytes each allow; a larger range is a task of its own."""
    tasks, size = [], most
    for r in ranges:
        cost = r.end - r.start + OPENING
        if size + cost > most:
            tasks.append([])
            size = 0
        tasks[-1].append(r)
        size += cost
    return [Ranges(t) for t in tasks]


class Bytes:
    """A file's bytes at any place, unmasked, through a window."""

    def __init__(self, file: pa.NativeFile, mask: bytes) -> None:
        self.file, self.mask, self.size = file, mask, file.size()
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            data, turn = self.file.read(max(n, WINDOW)), at % max(1, len(self.mask))
            self.at, self.held = at, masked(data, self.mask[turn:] + self.mask[:turn]) if self.mask else data
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        while at + len(what) <= self.size:
            part = self.get(at, min(WINDOW, self.size - at))
            found = part.find(what)
            if found >= 0:
                return at + found
            at += len(part) - len(what) + 1
        return -1


def frames_in(data: Bytes, start: int, end: int, magic: bytes, most: int, stop: bool, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the frames that start from ``start`` up to ``end``."""
    at = 0
    while at < end and at + len(magic) + 4 < data.size:
        head = data.get(at, len(magic) + 4)
        if not head.startswith(magic):
            at = data.find(magic, at)
            if at < 0:
                return
            continue
        size, body = int.from_bytes(head[len(magic) :], "little"), at + len(head)
        if not 0 < size <= most or body + size > data.size:
            if stop:
                return
            raise ValueError(f"{name}: the frame at {at} has a size of {size} in a file of {data.size} bytes")
        if at >= start:
            yield at, data.get(body, size)
        at = body + size


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.magic = options["path"], bytes.fromhex(options["magic"])
        self.mask = bytes.fromhex(options["mask"]) if "mask" in options else None
        self.step, self.most = int(options.get("rangeBytes", 128 << 20)), int(options.get("most", 1 << 31))
        self.task = int(options.get("taskBytes", TASK))
        bad = options.get("onBadFrame", "fail")
        if bad not in ("fail", "stop") or self.step < 1 or not self.magic:
            raise ValueError("onBadFrame is fail or stop, rangeBytes and magic are not empty")
        self.stop = bad == "stop"

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return store, [info]
        found = store.get_file_info(fs.FileSelector(path))
        return store, sorted((f for f in found if NUMBERED.match(f.base_name)), key=lambda f: f.base_name)

    def partitions(self) -> list[Ranges]:
        ranges = self._ranges()
        whole = sum(r.end - r.start + OPENING for r in ranges)
        return dealt(ranges, min(self.task, whole // SPREAD))

    def _ranges(self) -> list[Range]:
        store, files = self._files()
        mask = self.mask
        if mask is None:
            beside = [f"{f.path.rpartition('/')[0]}/{KEY_FILE}" for f in files[:1]]
            there = [p for p in beside if store.get_file_info(p).type == fs.FileType.File]
            mask = store.open_input_file(there[0]).read() if there else b""
        return [Range(f.path, at, min(f.size, at + self.step), mask) for f in files for at in range(0, f.size, self.step)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0]
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("block", pa.binary())])
        rows, size = [], 0
        for part in partition.ranges:
            with store.open_input_file(part.path) as file:
                for at, block in frames_in(Bytes(file, part.mask), part.start, part.end, self.magic, self.most, self.stop, part.path):
                    rows.append((part.path, at, block))
                    size += len(block)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blkdat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BlockReader:
        return BlockReader(dict(self.options) | {k: self.options[k] for k in ("rangeBytes", "taskBytes", "onBadFrame") if k in self.options})


def read_blocks(spark: SparkSession, path: str, magic: str, **options: object) -> DataFrame:
    """(path, offset, block) of all frames under ``path``."""
    spark.dataSource.register(BlockFiles)
    return spark.read.format("blkdat").options(magic=magic, **options).load(path)


def write_blocks(frames: DataFrame, folder: str, mask: bytes = b"") -> DataFrame:
    """Block files from ``frames`` (file, number, frame: bytes in hex), each written by one task, and their (name, bytes). The key of the mask is written beside them."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    if mask:
        with store.open_output_stream(f"{root}/{KEY_FILE}") as out:
            out.write(mask)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, place = fs.FileSystem.from_uri(folder)
        held: dict[int, list[bytes]] = {}
        for batch in batches:  # files one after another, their frames in order
            for file, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(file, []).append(frame)
            for file in list(held)[:-1]:
                yield written_file(target, place, file, held.pop(file))
        for file, parts in held.items():
            yield written_file(target, place, file, parts)

    def written_file(target: fs.FileSystem, place: str, file: int, parts: list[bytes]) -> pa.RecordBatch:
        name, data = f"blk{file:05d}.dat", b"".join(parts)
        with target.open_output_stream(f"{place}/{name}") as out:
            out.write(masked(data, mask) if mask else data)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["name", "bytes"])

    dealt = frames.repartition("file").sortWithinPartitions("file", "number")
    return dealt.select("file", F.unhex("frame").alias("frame")).mapInArrow(put, "name string, bytes long")
