"""Removal of byte strings that occur twice or more in a corpus, by sorting suffixes in range partitions.

Sorting every suffix with its first 400 bytes would move 400 times the text, so suffixes are thinned without
losing any repeat. Each 400-byte string chooses an anchor inside itself from its own bytes alone (the least hash of
eight bytes in its middle); equal strings choose alike. So the strings of one anchor form a run, and all of them contain
the same core around the anchor. A run whose core occurs once in the corpus has no repeated string.

1. Fingerprints of all cores are counted; a Bloom filter of those that occur twice or more spares the other suffixes.
2. The suffixes that pass, as the bytes of their runs, are range-partitioned by sampled splitters on their leading bytes, those of
   the core; then by row and place, which are unique, so a passage that a third of all documents share spreads over
   many buckets. Buckets sort locally by multikey quicksort: by the first eight bytes, those that tie by the next eight, and
   so on until they differ or the core ends.
3. Suffixes with one core are compared byte by byte, to the left and to the right of it, as far as their runs go. A pair
   that agrees over 400 bytes or more gives a repeat; the longest to each side is kept.
4. Groups at the ends of buckets are compared across boundaries by their bytes. Of those that go on in another bucket, every string
   of 400 bytes goes through a count of 128-bit digests.
5. The spans of all repeats are united per document and cut out.

The same sort also finds repeats of a number of words: a text is then the sequence of its words' 64-bit hashes, whatever
white space is between them, and what was said of bytes holds for words, eight bytes each.

Defined results: a null text is empty and loses nothing. Texts under the length stay whole. A row that repeats
another row counts as elsewhere. Rows are told apart by 128 bits of hashes of doc_id and text; a null doc_id is one value
of it. A text may be of any length; long ones are read in stretches. An empty table gives no rows. ``clean`` drops the
bytes of a character that a cut has split, and passes other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import BROADCAST_ROWS, Powers, as_bytes, bloom, by_place, checked, drop, lean, may_hold, slices, small_batches, text_or_empty, word_hashes, written

GRAM = 8
#: Bytes or words whose suffixes are found at once, each of which takes some 100 bytes of a worker.
CHUNK = 1 << 18
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A text, or the hashes of its words.
Units = bytes | np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(data: bytes) -> np.ndarray:
    """The eight bytes from each position, as big-endian words: their order is the order of the bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(min(GRAM, n)):
        part = np.frombuffer(data, ">u8", (len(data) - k) // GRAM, k)
        out[k::GRAM] = part[: len(out[k::GRAM])]
    return out


class Text:
    """A stretch of bytes or words whose substrings have fingerprints: sums of mixed grams, each times a power of its offset.
    A gram is eight bytes or one word."""

    def __init__(self, data: Units, powers: Powers) -> None:
        self.gram = GRAM if isinstance(data, bytes) else 1
        self.words = grams(data) if isinstance(data, bytes) else data
        self.hashes = _mix(self.words)
        up, self.inverse = powers.get(len(self.words) + 1)
        self.sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.hashes * up[:-1], out=self.sums[1:])

    def prints(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length - self.gram + 1] - self.sums[start]) * self.inverse[start])


class Shape:
    """Where the anchor of a string of ``length`` bytes or words lies: ``off`` to ``off + width - 1`` of them after its start."""

    def __init__(self, length: int, words: bool = False) -> None:
        self.length, self.words = length, words
        self.width = 1 << max(0, (length * 2 // 5).bit_length() - 1)
        self.off = (length - (1 if words else GRAM) - self.width) // 2
        self.core = length - self.width + 1
        self.reach = self.width - 1  # how far a run may go on each side of its core
        self.unit = 8 if words else 1
        if self.off < 0 or length > 1000:
            raise ValueError("length: 16 to 1,000 bytes, or 2 to 1,000 words")

    def units(self, texts: list[bytes]) -> list[Units]:
        return word_hashes(texts) if self.words else texts


def runs(text: Text, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of the strings of equal anchor; bounds: (first, last) start allowed."""
    if len(text.words) < shape.off + shape.width or not len(bounds):
        return (np.zeros(0, np.int64),) * 3
    n = len(text.words)
    place = np.uint64((1 << 21) - 1)
    least = (text.hashes & ~place) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < shape.width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least[shape.off :] & place).astype(np.int64)
    allowed = np.zeros(n + 2, np.int64)
    np.add.at(allowed, bounds[:, 0], np.arange(1, len(bounds) + 1))
    np.add.at(allowed, bounds[:, 1] + 1, -np.arange(1, len(bounds) + 1))
    part = np.cumsum(allowed)[: len(anchor)]
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
    last = np.r_[edge[1:], len(anchor)] - 1
    real = part[edge] > 0
    return anchor[edge][real], edge[real], last[real]


def stretches(texts: list[Units], length: int) -> Iterator[tuple[Units, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts joined, or parts of long ones that overlap by ``length`` - 1: bytes or words, (first, last) starts, text numbers,
    and the offset of the stretch in each text."""
    held, size = [], 0

    def joined():
        at = np.r_[0, np.cumsum([len(texts[i]) for i in held])][:-1]
        sizes = np.array([len(texts[i]) for i in held])
        parts = [texts[i] for i in held]
        return b"".join(parts) if isinstance(parts[0], bytes) else np.concatenate(parts), np.stack([at, at + sizes - length], 1), np.array(held), -at

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > CHUNK:
            for a in range(0, len(t) - length + 1, CHUNK):
                part = t[a : a + CHUNK + length - 1]
                yield part, np.array([[0, len(part) - length]]), np.array([i]), np.array([a])
            continue
        if held and size + len(t) > CHUNK:
            yield joined()
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield joined()


ROW = ["k1", "k2"]


def _anchored(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple]:
    """Of each stretch: the batch's part and text numbers, the stretch, begin of cores, first and last starts, the offset of the
    stretch in each run's text, and the fingerprints of the cores."""
    powers = Powers()
    for batch in batches:
        for part, texts in slices(batch, as_bytes(batch.column(2)), CHUNK):
            for data, bounds, number, shift in stretches(shape.units(texts), shape.length):
                text = Text(data, powers)
                anchor, first, last = runs(text, bounds, shape)
                own = np.searchsorted(bounds[:, 0], first, "right") - 1
                begin = anchor - shape.off
                yield part, number[own], data, begin, first, last, shift[own], text.prints(begin, shape.core)


def _prints(rows: DataFrame, shape: Shape) -> DataFrame:
    """(core): the fingerprint of each run's core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, core in _anchored(batches, shape):
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], names=["core"])

    return rows.mapInArrow(lean(run), "core long")


def _suffixes(rows: DataFrame, shape: Shape, twice: np.ndarray) -> DataFrame:
    """(k1, k2, at, cut, window): where a run's core begins in its text, and in the run's bytes; only of cores that may occur twice."""
    passing = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for part, number, data, begin, first, last, shift, core in _anchored(batches, shape):
            some = np.flatnonzero(may_hold(bits, core.view(np.int64)))
            if not len(some):
                continue
            begin, first, last = begin[some], first[some], last[some] + shape.length
            whole = data if isinstance(data, bytes) else data.astype(">u8").tobytes()
            u, own = shape.unit, pa.array(number[some])
            window = [whole[a:b] for a, b in zip((u * first).tolist(), (u * last).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(begin + shift[some]), pa.array((begin - first).astype(np.int32)), pa.array(window, pa.binary())], names=[*ROW, "at", "cut", "window"])

    return rows.mapInArrow(lean(run), "k1 long, k2 long, at long, cut int, window binary")


def multikey_order(n: int, depth: int, word: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of n rows by successive words, and the number of each place's group of equal rows. Rows are sorted by their first word;
    those that tie by the next, and so on; ``word(k, rows)`` gives the k-th word of some rows."""
    order, group = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places
    for k in range(depth if n > 1 else 0):
        part = order[tied]
        values = word(k, part)
        by = np.lexsort((values, group[tied]))
        order[tied] = part[by]
        values = values[by]
        held = group[tied]
        fresh = np.r_[False, (held[1:] == held[:-1]) & (values[1:] != values[:-1])]
        step = np.zeros(n, np.int64)
        step[tied[fresh]] = 1
        group = group + np.cumsum(step)
        same = np.r_[False, group[1:] == group[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
    return order, group


class Bucket:
    """The suffixes of a bucket: units of all windows in one array, the first and last of each, and where its core begins."""

    def __init__(self, window: pa.Array, cut: np.ndarray, shape: Shape) -> None:
        self.shape, buffers = shape, window.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[window.offset : window.offset + len(window) + 1].astype(np.int64)
        octets = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if len(window) else np.zeros(0, np.uint8)
        self.units = octets.view(">u8").astype(np.uint64) if shape.words else octets
        at = (offsets - offsets[0]) // shape.unit
        self.core = at[:-1] + cut
        self.left = cut.astype(np.int64)
        self.right = at[1:] - self.core - shape.core

    def word(self, k: int, rows: np.ndarray) -> np.ndarray:
        """Eight bytes of the cores, as numbers in the order of the bytes; the last eight may repeat some."""
        if self.shape.words:
            return self.units[self.core[rows] + k]
        at = self.core[rows] + min(8 * k, self.shape.core - 8)
        out = np.zeros(len(rows), np.uint64)
        for i in range(8):
            out = (out << np.uint64(8)) | self.units[at + i]
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        return multikey_order(len(self.core), self.shape.core if self.shape.words else -(-self.shape.core // 8), self.word)

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many units the windows of rows i and j have in common to the left and to the right of their cores."""
        out = [np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)]
        t = np.arange(self.shape.reach)
        for a in range(0, len(i), 4096):
            x, y = i[a : a + 4096], j[a : a + 4096]
            for side, (most, begin, way) in enumerate(((self.left, 0, -1 - t), (self.right, self.shape.core, t))):
                room = np.minimum(most[x], most[y])
                fits = t < room[:, None]
                place = lambda r: np.where(fits, self.core[r][:, None] + begin + way, 0)  # noqa: B023, E731
                same = fits & (self.units[place(x)] == self.units[place(y)])
                out[side][a : a + 4096] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        return out[0], out[1]

    def window(self, row: int) -> bytes:
        return self.units[self.core[row] - self.left[row] : self.core[row] + self.shape.core + self.right[row]].tobytes()

    def by_classes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many different windows of one core: the farthest that a string which another window also has goes to each side, -1
        without any. Windows are classed by their first x units to the left and by the others to the right, for each x."""
        n, reach = len(rows), self.shape.reach
        own = np.arange(n)

        def classes(most: np.ndarray, place: Callable[[int], np.ndarray]) -> list[np.ndarray]:
            out = [np.zeros(n, np.int64)]
            for x in range(reach):
                fits = most[rows] > x
                value = np.unique(self.units[np.where(fits, place(x), 0)], return_inverse=True)[1]
                out.append(np.unique(out[-1] * (2 * n + 1) + np.where(fits, value, n + own), return_inverse=True)[1])
            return out

        left = classes(self.left, lambda x: self.core[rows] - 1 - x)
        right = classes(self.right, lambda x: self.core[rows] + self.shape.core + x)
        best_left, best_right = np.full(n, -1), np.full(n, -1)
        for x in range(reach + 1):
            fits = np.flatnonzero((self.left[rows] >= x) & (self.right[rows] >= reach - x))
            number, count = np.unique(left[x][fits] * n + right[reach - x][fits], return_inverse=True, return_counts=True)[1:]
            hit = fits[count[number] > 1]
            best_left[hit] = x
            best_right[hit] = np.maximum(best_right[hit], reach - x)
        return best_left, best_right

    def repeats(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row, how far to the left and right of its core the repeats go that contain it; -1 without any."""
        reach, n = self.shape.reach, len(order)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        size = np.bincount(group) if n else np.zeros(0, np.int64)
        first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)

        def put(i: np.ndarray, j: np.ndarray) -> None:
            x, y = self.alike(i, j)
            good = x + y >= reach
            for r in (i, j):
                np.maximum.at(left, r[good], x[good])
                np.maximum.at(right, r[good], y[good])

        twos = first[size == 2]
        put(order[twos], order[twos + 1])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for g in np.flatnonzero(size > 2):
            rows = order[first[g] : first[g] + size[g]]
            known: dict[tuple, list[int]] = {}
            for r in rows.tolist():
                known.setdefault((int(self.left[r]), self.window(r)), []).append(r)
            for same in known.values():
                if len(same) > 1:  # whole runs that are alike
                    left[same], right[same] = self.left[same], self.right[same]
            kinds = np.array([same[0] for same in known.values()])
            if len(kinds) > PAIRWISE:
                x, y = self.by_classes(kinds)
                left[kinds], right[kinds] = np.maximum(left[kinds], x), np.maximum(right[kinds], y)
            elif len(kinds) > 1:
                i, j = np.triu_indices(len(kinds), 1)
                pairs.append((kinds[i], kinds[j]))
        if pairs:
            put(np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))
        return left, right


#: Found repeats have a start and a size in units. Rows of groups at a bucket's ends have the bucket, the window and its cut as well.
FOUND = "k1 long, k2 long, at long, start long, size int, bucket long, cut int, window binary"
#: So many suffixes in a bucket, about; some 20 MB of windows.
SUFFIXES = 40_000
#: Partitions of the shuffle; beyond, a partition holds several buckets one after another.
PARTITIONS = 20_000
#: Groups with more different windows than this are compared by classes, not pair by pair.
PAIRWISE = 24


def _sorted_buckets(suffixes: DataFrame, buckets: int, shape: Shape) -> DataFrame:
    """The repeats of each bucket, and the groups at its ends. With more than PARTITIONS buckets a partition is sorted by cores (Spark spills what doesn't fit) and cut into buckets of SUFFIXES as
    it is read, so that a task holds one bucket at a time."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    several, most = buckets > PARTITIONS, SUFFIXES

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if several and size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, held in enumerate(cut_up(batches)):
            yield from found(held, TaskContext.get().partitionId() << 32 | number)

    def found(held: list[pa.RecordBatch], name: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        k1, k2, at, cut = (table.column(i).to_numpy() for i in range(4))
        whole = table.column(4)
        bucket = Bucket(whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole, cut, shape)
        order, group = bucket.sorted()
        left, right = bucket.repeats(order, group)
        hit = np.flatnonzero(left >= 0)

        def out(rows: np.ndarray, start: np.ndarray | None, size: np.ndarray | None, ends: bool) -> pa.RecordBatch:
            n = len(rows)
            columns = [k1[rows], k2[rows], at[rows], start, size, np.full(n, name, np.int64) if ends else None, cut[rows] if ends else None]
            arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, whole.take(pa.array(rows)).combine_chunks() if ends and n else pa.nulls(n, pa.binary())], names=names)

        yield out(hit, at[hit] - left[hit], (left[hit] + shape.core + right[hit]).astype(np.int32), False)
        # of the groups at both ends, each different window once: they may go on in the next bucket
        ends = order[(group == group[0]) | (group == group[-1])]
        kinds = {(int(cut[r]), bucket.window(r)): r for r in ends.tolist()}
        yield out(np.array(list(kinds.values())), None, None, True)

    core = F.expr(f"substr(window, cut * {shape.unit} + 1, {shape.core * shape.unit})")
    dealt = suffixes.repartitionByRange(min(buckets, PARTITIONS), core, *ROW, "at")
    return (dealt.sortWithinPartitions(core) if several else dealt).mapInArrow(lean(run), FOUND)


def _across(ends: DataFrame, shape: Shape) -> DataFrame:
    """(k1, k2, start, size) of repeats of groups that go on in another bucket. Which do is told by the bytes of their cores. A window that stands in several buckets is a repeat as a
    whole; of each different window, one is compared with the others by digests of its strings."""
    core = F.expr(f"substr(window, cut * {shape.unit} + 1, {shape.core * shape.unit})")
    rows = ends.withColumn("core", core)
    wide = written(rows.groupBy("core").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo <> hi").select("core"), "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, at, digests = [], [], [], []
            for a, b, begin, cut, window in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for x in range(len(window) // shape.unit - shape.length + 1):
                    k1.append(a)
                    k2.append(b)
                    at.append(begin - cut + x)
                    digests.append(hashlib.blake2b(window[x * shape.unit : (x + shape.length) * shape.unit], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int64()), pa.array(digests, pa.binary())], names=[*ROW, "start", "digest"])

    some = written(rows.join(checked(wide), "core", "left_semi").select(*ROW, "at", "cut", "window"), "ends")
    kinds = some.groupBy("cut", "window").agg(F.min(F.struct(*ROW, "at")).alias("one"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds.select("one.*", "cut", "window", "n"), "kinds")
    alike = some.join(checked(kinds.where("n > 1").select("cut", "window")), ["cut", "window"], "left_semi")
    alike = alike.select(*ROW, (F.col("at") - F.col("cut")).alias("start"), (F.octet_length("window") / shape.unit).cast("int").alias("size"))
    strings = written(kinds.select(*ROW, "at", "cut", "window").mapInArrow(lean(run), "k1 long, k2 long, start long, digest binary"), "strings")
    twice = written(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "twice")
    found = strings.join(checked(twice), "digest", "left_semi").select(*ROW, "start", F.lit(shape.length).alias("size"))
    out = written(alike.unionByName(found), "across")
    drop(wide, some, kinds, strings, twice)
    return out


#: Of a repeat: its start, and how many bytes or words it has (under 4,096).
def unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans >> 12, (spans >> 12) + (spans & 4095)


def covered(n: int, repeats: np.ndarray) -> np.ndarray:
    """Which of n bytes or words lie in a repeat."""
    delta = np.zeros(n + 1, np.int64)
    start, end = unpacked(repeats)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:-1]) > 0


def covered_words(data: bytes, repeats: np.ndarray) -> np.ndarray:
    """Which bytes lie in a repeat of words, white space inside it included."""
    edges = np.array([m.span() for m in WORD.finditer(data)], np.int64).reshape(-1, 2)
    delta = np.zeros(len(data) + 1, np.int64)
    start, end = unpacked(repeats)
    np.add.at(delta, edges[start, 0], 1)
    np.add.at(delta, edges[end - 1, 1], -1)
    return np.cumsum(delta[:-1]) > 0


SPLIT = re.compile(rb"((?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+)|[\x80-\xff]")


def whole_characters(data: bytes) -> bytes:
    """``data`` without the bytes that cuts have left of split characters."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return b"".join(m[1] or b"" for m in SPLIT.finditer(data)).decode("utf-8", "ignore").encode()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("row"), "text", "doc_id")})


def spans(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """(k1, k2, repeats): the repeats, packed, in each row of keyed() that has any; ``length`` is in bytes or words."""
    small_batches(docs.sparkSession)
    spark, shape = docs.sparkSession, Shape(length, words)
    rows = keyed(docs).select(*ROW, text_or_empty().alias("text")).where(f"octet_length(text) >= {2 * length - 1 if words else length}")
    counted = _prints(rows, shape).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(counted, "cores")
    cores, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    suffixes = _suffixes(rows, shape, bloom(counted.select("core"), cores))
    found = written(_sorted_buckets(suffixes, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SUFFIXES + 1), shape), "buckets")
    drop(counted)
    across = _across(found.where("bucket is not null"), shape)
    every = found.where("bucket is null").select(*ROW, "start", "size").unionByName(across)
    packed = F.shiftleft("start", 12).bitwiseOR(F.col("size").cast("long"))
    out = written(every.groupBy(*ROW).agg(F.collect_set(packed).alias("repeats")), "repeats")
    drop(found, across)
    return out


def _with_repeats(docs: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """keyed() rows with their repeats, and with those of words; rows without any aren't shuffled where the others' keys can
    be broadcast."""
    found, rows = spans(docs, length), keyed(docs)
    if words:
        of_words = spans(docs, words, True)
        both = written(found.join(of_words.withColumnRenamed("repeats", "word_repeats"), ROW, "full"), "both")
        drop(found, of_words)
        found = both
    if found.count() > BROADCAST_ROWS:
        return rows.join(found, ROW, "left")
    keys = F.broadcast(found.select(*ROW))
    none = [F.lit(None).cast("array<bigint>").alias(c) for c in found.columns[2:]]
    return rows.join(keys, ROW, "left_semi").join(found, ROW).unionByName(rows.join(keys, ROW, "left_anti").select("*", *none))


def removed(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: one row per row of ``docs``. ``text`` is what is left, without the bytes of
    a character that a cut has split."""
    docs = by_place(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, repeats in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = covered(len(data), np.array(repeats or [], np.int64))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if repeats else data
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), whole_characters(kept).decode()))
            n, out, count, digest, text = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    rows = _with_repeats(docs.select("doc_id", "text"), length).select("doc_id", "text", "repeats")
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def clean(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with repeats of ``length`` bytes, and of ``words`` words where told, cut out of the texts; n_chars, where
    there is one, follows. No row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, (repeats, of_words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if repeats or of_words:
                    data = texts[i].encode()
                    gone = covered(len(data), np.array(repeats or [], np.int64))
                    if of_words:
                        gone |= covered_words(data, np.array(of_words, np.int64))
                    texts[i] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[3:]], names=["text", *batch.schema.names[3:]])

    placed = by_place(docs, "doc_id", "text", "n_chars")
    rest = [c for c in placed.columns if c != "text"]
    boxed = placed.select(F.struct(*rest).alias("rest"), "doc_id", "text")
    joined = _with_repeats(boxed, length, words)
    of_words = F.col("word_repeats") if words else F.lit(None).cast("array<bigint>").alias("word_repeats")
    joined = joined.select("text", "repeats", of_words, "rest")
    out = joined.mapInArrow(lean(run), StructType([placed.schema["text"], StructField("rest", joined.schema["rest"].dataType)]))
    out = out.select("text", "rest.*").select(placed.columns)
    if "n_chars" in placed.columns:
        out = out.withColumn("n_chars", F.length("text").cast(placed.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
