"""What the operators share: the folder for intermediate tables, words, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import drop, fresh_path, written  # noqa: F401

#: White space as all contracts here define it; also what ``bytes.split()`` splits at.
SPACES = r"[\x20\x09-\x0D]+"
#: A side with at most so many narrow rows (under 100 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small: a task holds one batch at a time. All operators set the same numbers, so the
    order in which their lazy results run makes no difference; for the same reason they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")


def by_place(docs: DataFrame, *named: str) -> DataFrame:
    """``docs`` with the columns ``named`` under their names, in any order of columns, and all others under names of their places: whatever
    they were called, no expression can confuse them. ``toDF(*docs.columns)`` brings the names back."""
    left = list(named)
    names = []
    for i, c in enumerate(docs.columns):
        names.append(c if c in left else f"_extra{i}")
        if c in left:
            left.remove(c)
    return docs.toDF(*names)


def give_back() -> None:
    """What this process has freed but still holds goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_freed(most: int = 1 << 26) -> None:
    """From now on this process keeps up to ``most`` bytes of what it frees, until ``give_back``, where the C library can do that: a loop that makes arrays of
    some megabytes each time would otherwise get every page of them from the system anew."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-1, most)  # how much may be free before it goes back
        option(-3, 1 << 25)  # arrays from this size on are taken from the system each by itself


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a step for mapInArrow, after which its worker gives memory back: Spark keeps workers for later tasks, several to an executor, and what
    they hold meanwhile adds to what those of other stages take."""

    @wraps(run)
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return step


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in runs of whole rows with about ``most`` bytes of text; a longer text is alone in its run."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: The bytes of a word weigh by a random table and by powers of an odd number, modulo 2**64.
_WEIGHTS = np.random.default_rng(97).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, each of which takes some 60 bytes of a worker; a word of more bytes than LONG_WORD is hashed on its own.
BLOCK, LONG_WORD = 1 << 18, 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int = _BASE) -> None:
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            made = []
            for base in (self.base, pow(self.base, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` and their first bytes' places."""
    octets = np.frombuffer(data, np.uint8)
    word = np.zeros(len(octets) + 2, np.int8)
    word[1:-1] = ~_SPACE[octets]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _POWERS.get(len(octets) + 1)
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(_WEIGHTS[octets] * up[:-1], out=sums[1:])
    found = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return found, starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words, in order: a word has one hash wherever it stands. Short texts are hashed together, a long
    one in blocks that end at white space."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        found, starts = _hash_block(b" ".join(texts[i] for i in held))
        begin = np.cumsum([0, *(len(texts[i]) + 1 for i in held)])
        cut = np.searchsorted(starts, begin)
        for i, a, b in zip(held, cut, cut[1:], strict=False):
            out[i] = found[a:b]

    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            parts, at = [], 0
            while at < len(text):
                stop = _BREAK.search(text, min(len(text), at + BLOCK))
                end = stop.start() if stop else len(text)
                if end - at <= 4 * BLOCK:
                    parts.append(_hash_block(text[at:end])[0])
                else:  # a very long word, and others before it
                    parts += [_hash_block(w)[0] if len(w) <= LONG_WORD else np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in text[at:end].split()]
                at = end
            out[i] = np.concatenate(parts)
            continue
        if held and size + len(text) > BLOCK:
            flush()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        flush()
    return out


def checked(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow side of a join, broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= bound else df


CELL = 4096


def cells(own: np.ndarray) -> pa.RecordBatch:
    """A task's part of an array that tasks add up: a row for each 4,096 numbers that aren't all zero."""
    parts = own.reshape(-1, CELL)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["cell", "part"])


def folded(parts: DataFrame, length: int, kind: str, fold: np.ufunc) -> np.ndarray:
    """The arrays of all tasks (rows of ``cells``), folded by ``np.add`` or ``np.bitwise_or`` on the executors. What reaches the driver
    is one array of a fixed ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(part, kind)
                sums[cell] = fold(sums[cell], x) if cell in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cell", "part"])

    got = parts.select("cell", "part").repartition(8, "cell").mapInArrow(lean(run), "cell int, part binary").toArrow()
    out = np.zeros(length, kind)
    for cell, part in zip(got["cell"].to_pylist(), got["part"].to_pylist(), strict=True):
        out[cell * CELL : (cell + 1) * CELL] = np.frombuffer(part, kind)
    return out


def _bloom_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = keys.view(np.uint64)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        yield ((x * np.uint64(odd)) >> np.uint64(20)).astype(np.int64) & (bits - 1)


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, 32 MB at most: it only spares work, what passes is joined exactly."""
    bits = min(1 << 28, max(1 << 15, 1 << (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield cells(own)

    return folded(keys.mapInArrow(lean(run), "cell int, part binary"), bits // 8, "u1", np.bitwise_or)


def may_hold(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _bloom_places(keys, 8 * len(filter_bits)):
        found &= (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found
