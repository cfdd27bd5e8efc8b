"""Packing of token pieces into sequences: best-fit decreasing, then swap-based local search.

Pieces are dealt by a hash into groups of bounded size, which are packed independently. In a group, bins that are not
full exchange one piece for one, two for one, or pass one or two pieces on; every step raises the sum of squared fills, so
the emptiest bins drain and vanish. The search ends where no step is left, or at the least number of bins. What stays in
underfull bins is dealt again into fewer groups, until one group is left or a deal empties no bin: the whole corpus ends with
the waste of a few bins, and no task holds more than one group.

Defined results: a null or empty text is one piece with the end id only. Only documents longer than a sequence
are cut. Rows that repeat a doc_id are packed as documents of their own (their piece rows are alike). A null doc_id
is packed like any other. Rows are dealt by their place in a written table, so that equal ones spread too. A text may be of any
length; an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, drop, slices, small_batches, written
from .word_tokens import encoder_of, with_end

#: Pieces in a group: what one task packs.
GROUP = 10_000
#: Of several groups, bins that lack no more than this share of the capacity are final; the others are dealt again.
LOOSE = 0.005


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                doc, piece, start, length, crc = [], [], [], [], []
                for i, ids in zip(part.column(0).to_pylist(), map(with_end, encoder.encode(texts)), strict=True):
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([pa.array(doc, part.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each piece: longest first, each into the fullest bin that has room.

    Bins are kept by their room; a bit mask of the rooms that occur finds the smallest that is enough."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, count = capacity, count, count + 1
        bins[i] = b
        room -= size
        by_room[room].append(b)
        mask |= 1 << room
    return bins


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Drains the emptiest bins by moves and exchanges; each step raises the sum of squared fills. Of the emptiest bin's pieces, each
    one and each two are tried; pieces of one size are alike, so a bin has few of them to try."""
    bins = bins.copy()
    least = -(-int(sizes.sum()) // capacity)
    fill = np.bincount(bins, sizes).astype(np.int64)
    loose = np.flatnonzero(fill[bins] < capacity)
    size, at = sizes[loose].astype(np.int64), bins[loose].copy()
    count, stuck, stepped = int((fill > 0).sum()), np.zeros(len(fill), bool), False
    while count > least:
        live = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(live):
            if not stepped:
                break
            stuck[:], stepped = False, False  # steps may have made room for those that found none
            continue
        a = int(live[np.argmin(fill[live])])
        mine = np.flatnonzero(at == a)
        kinds, first, number = np.unique(size[mine], return_index=True, return_counts=True)
        i, j = np.triu_indices(len(kinds))
        pair = (i != j) | (number[i] > 1)
        i, j = i[pair], j[pair]
        out = np.r_[kinds, kinds[i] + kinds[j]]
        order = np.argsort(out, kind="stable")
        out = out[order]
        room = capacity - fill
        room[a] = -1
        room[(fill == 0) | (fill >= capacity)] = -1
        gain, back, b, chosen = 0, -1, -1, -1
        others = np.flatnonzero(room > 0)
        others = others[np.argsort(room[others], kind="stable")]
        to = np.searchsorted(room[others], out)  # the fullest bin with room for each
        fits = np.flatnonzero(to < len(others))
        fits = fits[fill[others[to[fits]]] + out[fits] > fill[a]]
        if len(fits):
            chosen = int(fits[-1])
            gain, b = int(out[chosen]), int(others[to[chosen]])
        best = np.searchsorted(out, size + np.maximum(room[at], 0), "right") - 1
        more = np.where((best >= 0) & (room[at] > 0), out[best] - size, 0)
        more[fill[at] + more <= fill[a]] = 0
        if len(more) and int(more.max()) > gain:
            back = int(np.argmax(more))
            gain, b, chosen = int(more[back]), int(at[back]), int(best[back])
        if gain <= 0:
            stuck[a] = True
            continue
        stepped = True
        kind = int(order[chosen])
        if kind < len(kinds):
            leave = [mine[first[kind]]]
        else:
            x, y = i[kind - len(kinds)], j[kind - len(kinds)]
            same = mine[size[mine] == kinds[x]]
            leave = [same[0], same[1] if x == y else mine[first[y]]]
        at[leave] = b
        if back >= 0:
            at[back] = a
        fill[a] -= gain
        fill[b] += gain
        count -= fill[a] == 0
    bins[loose] = at
    return bins


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return improve(sizes, best_fit(sizes, capacity), capacity)


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PLACED = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, dealt long, turn int, sequence_id long, offset long, fill long"


def _packed(rows: DataFrame, groups: int, turn: int, capacity: int, kind: str) -> DataFrame:
    """Each group packed; sequence numbers hold the turn, the group and the bin."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = frame["length"].to_numpy(np.int64)
        bins = np.unique(pack(sizes, capacity), return_inverse=True)[1]
        order = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(sizes[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        before = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - sizes[order] - before
        group = int(frame["dealt"].iloc[0])
        return frame.assign(turn=turn, sequence_id=(turn << 58) | (group << 24) | bins, offset=offset, fill=np.bincount(bins, sizes).astype(np.int64)[bins])

    place = F.xxhash64("_metadata.file_name", "_metadata.row_index", F.lit(turn))
    dealt = rows.select(*PIECE, F.pmod(place, F.lit(groups)).alias("dealt"))
    return dealt.groupBy("dealt").applyInPandas(run, PLACED.format(kind=kind))


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, done, turn, before = written(pieces(docs, tokenizer, capacity), "pieces"), [], 0, None
    while True:
        groups = max(1, -(-rows.count() // GROUP))
        placed = written(_packed(rows, groups, turn, capacity, kind), "packed")
        if turn == 0:
            drop(rows)
        tight = F.col("fill") >= int(capacity * (1 - LOOSE))
        loose = placed.where(~tight)
        now = placed.select("sequence_id", "fill").distinct().agg(F.count(F.lit(1)).alias("all"), F.count_if(~tight).alias("loose")).first()
        if groups == 1 or not now["loose"] or (before is not None and now["all"] >= before):
            done.append(placed)
            break
        done.append(placed.where(tight))
        rows, before, turn = loose, now["loose"], turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*PIECE, "sequence_id", "offset")
