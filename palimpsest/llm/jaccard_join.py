"""Exact Jaccard self-join of documents on word shingles: a size-aware heavy-light join.

* Light (small sets): all subsets of the fixed size that two linked sets must share are enumerated, as sums of
  element hashes; sets that meet under one subset are linked at once, to the smallest of them, without pairs.
* Heavy (large sets): inverted lists over the prefix of each set in rarest-first order are scanned. Rarity comes
  from a count sketch of fixed size over all documents. At first the members of a list meet its smallest one only, so
  a group of near copies costs a star, not a square. What is connected needs no further comparison; in lists that still hold
  several components, short ones give all pairs of different components, and members of long ones meet pivots of their
  own band of sizes and of the next ones, four times as many in each round, until no list is left. Sizes, places in the
  prefixes and parity bits of the sets rule out most candidates; the others are verified on whole sets.
* The boundary between the two is the size at which enumeration costs more than the scan, by the
  sketch's own figures.

Equal sets are one class with one representative from the start; so copies are never paired. Sets hold 64-bit hashes of
shingles and are told apart by 128 bits; with random hashes, two shingles of one comparison are confused with a chance
below n * n / 2**64 for sets of n.

Defined results: a text without words (or null) has an empty set and is linked with nothing, not even with another
empty one. One or two words (fewer than the shingle length) are one shingle. A text may be of any length; its set is held by one
task at a time. A row without doc_id gets the component of its text. Rows that repeat a doc_id share a component. Other columns,
whatever their names, are ignored by ``join`` and passed on by ``keep_one``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import as_bytes, bloom, by_place, cells, checked, drop, folded, lean, may_hold, mixed, slices, small_batches, word_hashes, written

SKETCH = 1 << 21
#: Elements that a task holds before it counts them.
HELD = 250_000
#: A list with at most so many members gives all its pairs; a longer one has pivots, so many in its first round.
SHORT, PIVOTS = 12, 16
#: The parity of a set's elements in each of 256 classes, in 64-bit words.
PARITY = ["b0", "b1", "b2", "b3"]


def shingle_sets(texts: list[bytes], k: int = 3) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text: A-Z in lower case, words, ``k`` at a time."""
    sets = []
    for h in word_hashes([t.lower() for t in texts]):
        if 0 < len(h) < k:
            h = mixed(np.array([len(h)], np.uint64) + sum(mixed(h[i : i + 1] + np.uint64(i + 1)) for i in range(len(h))))
        elif len(h):
            n = len(h) - k + 1
            shingles = np.zeros(n, np.uint64)
            for i in range(k):
                shingles = mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
            shingles.sort()
            h = shingles[np.r_[True, shingles[1:] != shingles[:-1]]]
        sets.append(h)
    return sets


def keys_of(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def parity_of(s: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many elements as in classes of unequal parity."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_overlap(n: int, m: int, pct: int) -> int:
    """The smallest i with 100 i >= pct (n + m - i)."""
    return -(-pct * (n + m) // (100 + pct))


def light_pairs(n: int, pct: int, most: int) -> list[tuple[int, int, int]]:
    """For a set of size n: (smaller size, larger size, overlap) of each pair of sizes that can link."""
    out = []
    for m in range(-(-pct * n // 100), min(most, 100 * n // pct) + 1):
        low, high = min(n, m), max(n, m)
        o = least_overlap(n, m, pct)
        if o <= low and o < high:  # else only equal sets, which are one class already
            out.append((low, high, o))
    return out


def enumerated(n: int, pct: int, most: int) -> int:
    return sum(comb(n, o) for _, _, o in light_pairs(n, pct, most))


def boundary(total: float, squares: float, pct: int) -> int:
    """The largest size up to which a set's subsets are fewer than the entries its scan would meet.

    A scan reads the lists of prefix elements; the expected rest of a list is the size-biased load of the
    sketch, less what falls together by chance. Subsets grow faster than any power of the size, so there is a boundary.
    """
    beside = max(1.0, squares / total - total / SKETCH) if total else 1.0
    n = 1
    while n < 100 and enumerated(n, pct, n) <= (n - -(-pct * n // 100) + 1) * (1 + beside):
        n += 1
    return n - 1


@cache
def left_out(n: int, few: int) -> np.ndarray:
    """Each choice of ``few`` of n places, in a row."""
    return np.array(list(combinations(range(n), few)), np.int64).reshape(comb(n, few), few)


def counted(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)


def _measured(docs: DataFrame, k: int) -> DataFrame:
    """Of each document: size and key of its set; of each task: its part of the sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, held, schema = np.zeros(SKETCH, np.int64), [], None
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                sets = shingle_sets(texts, k)
                held += sets
                if sum(map(len, held)) > HELD:
                    load += counted(held)
                    held = []
                keys = [keys_of(s) for s in sets]
                bits = np.array([parity_of(s) for s in sets])
                out = pa.table({
                    "doc_id": part.column(0),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array([a for a, _ in keys], pa.int64()),
                    "k2": pa.array([b for _, b in keys], pa.int64()),
                    **{name: pa.array(bits[:, i]) for i, name in enumerate(PARITY)},
                    "cell": pa.nulls(len(sets), pa.int32()),
                    "part": pa.nulls(len(sets), pa.binary()),
                })
                schema = out.schema
                yield from out.to_batches()
        if schema is not None:
            if held:
                load += counted(held)
            own = cells(np.minimum(load, np.iinfo(np.int32).max).astype(np.int32))
            none = pa.nulls(own.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none.cast(schema.field(0).type), *[none] * 7, own.column(0), own.column(1)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n long, k1 long, k2 long, b0 long, b1 long, b2 long, b3 long, cell int, part binary")


def _sketch(measured: DataFrame) -> tuple[np.ndarray, float, float]:
    """The load of each counter, the sum of all, and the sum of the entries that each meets beside itself."""
    load = folded(measured.where("cell is not null"), SKETCH, "i4", np.add)
    wide = load.astype(np.float64)
    return load, float(wide.sum()), float((wide * (wide - 1)).sum())


def _entries(docs: DataFrame, reps: DataFrame, gone: DataFrame, k: int, pct: int, light: int, load: np.ndarray) -> DataFrame:
    """Rows of the two joins for each representative. light: (s1, s2, low, np, rep), a subset and a set that has it;
    heavy: (s1, np, rep), an element of a prefix and the set (s2 null). np holds the set's size and the element's place in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = docs.sparkSession.sparkContext.broadcast(load)
    scanned_from = -(-pct * (light + 1) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = order.value
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                s1, s2, low, place, has = [], [], [], [], []
                sets = shingle_sets(texts, k)
                rows = np.zeros(len(sets), np.int64)
                for i, s in enumerate(sets):
                    n = len(s)
                    if 0 < n <= light:
                        a, b = mixed(s), mixed(s ^ np.uint64(0x5851F42D4C957F2D))
                        for small, high, o in light_pairs(n, pct, light):
                            gone_of = left_out(n, n - o)
                            tag = np.uint64((small << 32) | (high << 16) | o)
                            s1.append(mixed(a.sum() - a[gone_of].sum(axis=1, dtype=np.uint64) + tag))
                            s2.append(b.sum() - b[gone_of].sum(axis=1, dtype=np.uint64))
                            low.append(np.full(len(gone_of), small))
                            place.append(np.zeros(len(gone_of), np.int64))
                            has.append(np.ones(len(gone_of), bool))
                            rows[i] += len(gone_of)
                    if n >= scanned_from and n > 1:
                        prefix = s[np.lexsort((s, rare[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[: n - -(-pct * n // 100) + 1]]
                        s1.append(prefix)
                        s2.append(np.zeros(len(prefix), np.uint64))
                        low.append(np.zeros(len(prefix), np.int64))
                        place.append(np.arange(len(prefix)))
                        has.append(np.zeros(len(prefix), bool))
                        rows[i] += len(prefix)
                if not rows.sum():
                    continue
                cat, mask = np.concatenate, ~np.concatenate(has)
                own = np.repeat(np.arange(len(sets)), rows)
                size = np.array([len(s) for s in sets], np.int64)[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cat(s1).astype(np.uint64).view(np.int64)),
                        pa.array(cat(s2).astype(np.uint64).view(np.int64), mask=mask),
                        pa.array(cat(low).astype(np.int32)),
                        pa.array((size << 32) | cat(place)),
                        part.column(0).take(pa.array(own)),
                    ],
                    names=["s1", "s2", "low", "np", "rep"],
                )

    shape, texts = f"s1 long, s2 long, low int, np long, rep {kind}", docs.select("doc_id", "text").where("doc_id is not null")
    few = checked(gone)
    if few is not gone:
        return texts.join(few, "doc_id", "left_anti").mapInArrow(lean(run), shape)
    # many copies: not the texts are joined, but the narrow entries
    return texts.mapInArrow(lean(run), shape).join(reps.select("rep").distinct(), "rep", "left_semi")


def _possible(x: str, y: str, pct: int) -> str:
    """A condition on two members of a list, of np ``x`` and ``y``: sizes and places that leave room for the overlap."""
    n, m = f"({x} div 4294967296)", f"({y} div 4294967296)"
    need = f"(({pct} * ({n} + {m}) + {99 + pct}) div {100 + pct})"
    return f"least({n} - {x} % 4294967296, {m} - {y} % 4294967296) >= {need}"


def _light_links(entries: DataFrame) -> DataFrame:
    """(a, b): sets under one subset, linked to the smallest of them; exact, as the subset is the overlap they need."""
    own = entries.where("s2 is not null")
    keys = own.groupBy("s1", "s2").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min(F.when(F.expr("np div 4294967296 = low"), F.col("rep"))).alias("least"))
    shared = written(keys.where("lo <> hi and least is not null").select("s1", "s2", "least"), "subsets")
    links = own.select("s1", "s2", "rep").join(checked(shared), ["s1", "s2"]).where("rep <> least").selectExpr("rep as a", "least as b").distinct()
    out = written(links, "links")
    drop(shared)
    return out


def _first_round(entries: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each list's smallest member and the others, and the entries of lists with three members or more."""
    own = entries.where("s2 is null")
    heads = own.groupBy("s1").agg(F.count(F.lit(1)).alias("length"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min_by("np", "rep").alias("x"), F.max_by("np", "rep").alias("y"))
    heads = written(heads.where("lo <> hi"), "heads")
    lists = own.select("s1", "np", "rep").join(checked(heads.where("length > 2").selectExpr("s1", "lo", "x as lo_np")), "s1")
    lists = written(lists, "lists")
    twos = heads.where("length = 2").where(_possible("x", "y", pct)).selectExpr("hi as a", "lo as b")
    others = lists.where("rep <> lo").where(_possible("np", "lo_np", pct)).selectExpr("rep as a", "lo as b")
    pairs = written(twos.unionByName(others).distinct(), "pairs")
    drop(heads)
    return pairs, lists


def _open_lists(lists: DataFrame, stars: DataFrame) -> DataFrame:
    """The entries of lists that aren't yet within one component, with their components and the lists' lengths."""
    rows = lists.select("s1", "np", "rep").join(checked(stars.withColumnRenamed("node", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = written(rows, "named")
    spread = rows.groupBy("s1").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("length"))
    still = written(spread.where("lo <> hi").select("s1", "length"), "open")
    out = written(rows.join(checked(still), "s1"), "lists")
    drop(rows, still)
    return out


def _short_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """All pairs of different components within the lists of at most SHORT members."""
    members = rows.where(f"length <= {SHORT}").groupBy("s1").agg(F.collect_list(F.struct("rep", "np", "component")).alias("m"))
    fits = f"y.rep < x.rep and y.component <> x.component and {_possible('x.np', 'y.np', pct)}"
    pairs = members.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.expr(f"filter(m, y -> {fits})")).alias("y"))
    return pairs.selectExpr("x.rep as a", "y.rep as b")


def _long_pairs(rows: DataFrame, pivots: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of members and pivots in longer lists, and the entries left when the pivots have gone. Sizes that can link
    lie in one band or in neighbouring ones."""
    band = F.floor(F.log(F.expr("np div 4294967296").cast("double")) / log(100 / pct)) if pct < 100 else F.expr("np div 4294967296")
    long = rows.where(f"length > {SHORT}").select("s1", "np", "rep", "component", band.cast("int").alias("band"))
    slot = F.pmod(F.xxhash64("rep"), F.lit(pivots)).alias("slot")
    chosen = long.groupBy("s1", "band", slot).agg(F.min("rep").alias("p"), F.min_by("np", "rep").alias("p_np"), F.min_by("component", "rep").alias("p_component"))
    chosen = written(chosen, "pivots")
    near = chosen.select("s1", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "p", "p_np", "p_component")
    met = long.join(checked(near), ["s1", "band"]).where(f"rep <> p and component <> p_component and {_possible('np', 'p_np', pct)}")
    left = long.join(checked(chosen.selectExpr("s1", "p as rep")), ["s1", "rep"], "left_anti").select("s1", "np", "rep")
    return met.selectExpr("greatest(rep, p) as a", "least(rep, p) as b"), left


def _set_arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, items): the whole sets of the representatives in ``wanted`` (rep, k1, k2), made of the texts again. A Bloom filter of their
    ids spares the other texts."""
    spark = docs.sparkSession
    passing = spark.sparkContext.broadcast(bloom(wanted.select(F.xxhash64("rep")), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for batch in batches:
            some = np.flatnonzero(may_hold(bits, batch.column(0).to_numpy()))
            if not len(some):
                continue
            batch = batch.take(pa.array(some))
            for _, texts in slices(batch, as_bytes(batch.column(1))):
                sets = [s for s in shingle_sets(texts, k) if len(s)]
                if sets:
                    keys = np.array([keys_of(s) for s in sets], np.int64)
                    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                    items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), items], names=["k1", "k2", "items"])

    arrays = docs.where("doc_id is not null").select(F.xxhash64("doc_id"), "text").mapInArrow(lean(run), "k1 long, k2 long, items array<bigint>")
    # rows that repeat a doc_id may have other sets, and a set may be read twice; the wanted side names each set once
    return arrays.join(checked(wanted), ["k1", "k2"]).select("rep", "items").dropDuplicates(["rep"])


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, pct: int) -> DataFrame:
    """Those pairs (a, b) of representatives whose sets overlap enough; what parity doesn't rule out is compared whole."""
    bits = reps.select("rep", "n", *PARITY)
    side = lambda name, own: checked(bits.select(F.col("rep").alias(name), F.struct("n", *PARITY).alias(own)))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in PARITY)
    need = f"(({pct} * (x.n + y.n) + {99 + pct}) div {100 + pct})"
    near = written(both.where(f"{apart} <= x.n + y.n - 2 * {need}").select("a", "b").distinct(), "near")
    sides = near.selectExpr("a as rep").unionByName(near.selectExpr("b as rep")).distinct()
    wanted = written(reps.join(checked(sides), "rep").select("rep", "k1", "k2"), "wanted")
    arrays = written(_set_arrays(docs, wanted, k), "arrays")
    held = near.join(arrays.selectExpr("rep as b", "items as y"), "b").join(arrays.selectExpr("rep as a", "items as x"), "a")
    held = held.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    out = written(held.where(f"100 * both >= {pct} * (n + m - both)").select("a", "b"), "links")
    drop(near, wanted, arrays)
    return out


def join(docs: DataFrame, pct: int = 90, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = by_place(docs, "doc_id", "text")
    measured = written(_measured(docs, k), "sets")
    sized = measured.where("cell is null").select("doc_id", "n", "k1", "k2", *PARITY)
    load, total, beside = _sketch(measured)
    light = boundary(total, beside, pct)
    least = [F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in PARITY)]
    reps = written(sized.where("n > 0").groupBy("k1", "k2").agg(*least).where("rep is not null"), "reps")
    copies = sized.where("n > 0").select("doc_id", "k1", "k2").join(reps.select("rep", "k1", "k2"), ["k1", "k2"]).where("doc_id <> rep").select("doc_id").distinct()
    gone = written(copies.join(reps.selectExpr("rep as doc_id").distinct(), "doc_id", "left_anti"), "copies")
    entries = written(_entries(docs, reps, gone, k, pct, light, load), "entries")
    links = _light_links(entries)
    pairs, lists = _first_round(entries, pct)
    drop(entries, gone)
    stars, pivots = None, PIVOTS
    while True:
        found = _verified(docs, reps, pairs, k, pct)
        if stars is None:
            stars = components(links.unionByName(found))
            drop(links)
        elif not found.isEmpty():
            was, stars = stars, components(stars.selectExpr("node as a", "component as b").unionByName(found))
            drop(was)
        drop(pairs, found)
        rows = _open_lists(lists, stars)
        drop(lists)
        if rows.isEmpty():
            drop(rows)
            break
        met, left = _long_pairs(rows, pivots, pct)
        pairs, lists = written(met.unionByName(_short_pairs(rows, pct)).distinct(), "pairs"), written(left, "lists")
        drop(rows)
        pivots *= 4
    named = reps.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sized.drop(*PARITY).join(named, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, pct: int = 90, k: int = 3) -> DataFrame:
    """The rows of ``docs`` without those that are linked, over any number of links, with a smaller doc_id."""
    placed = by_place(docs, "doc_id", "text")
    gone = written(join(placed, pct, k).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return placed.join(checked(gone), "doc_id", "left_anti").select(placed.columns).toDF(*docs.columns)
