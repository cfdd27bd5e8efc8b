"""Periodic runs of words, by the longest-previous-factor array and Main's extensions.

A run is a stretch of words with a smallest period q that no neighbouring word extends, of ``least`` words and ``EXPONENT`` periods or more.

1. A suffix array of a slice of documents, refined by doubling up to ``least * 2 / 3`` words, shows which documents can hold a run: in one of
   length m and period q, the word q places after its start begins m - q >= 2 m / 3 words that also begin at its start.
2. Of those documents, the whole suffix array and its common prefixes give each word's longest previous factor and where that stands; they cut the
   document into Lempel-Ziv blocks.
3. A run that a border of blocks cuts or touches is found there: Z functions to both sides of the border give, for each period, how far the words
   agree before and after. If it is the last border in the run, the run is shorter than 3 / 2 of the two blocks beside it, so the work is linear.
4. A run inside one block also stands where the block was copied from, and earlier. Runs lie in buckets by their start, and a block
   copies the buckets of its source from left to right, its own new ones too where the two overlap.

Defined results: a null or empty text has no words, so no runs. A text may be of any length; it is never cut, and takes some 200 bytes of memory
a word. Repeated rows, and rows that repeat a doc_id or have none, each get their own row. Bytes that aren't UTF-8 are kept as they are.
An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_repeats import walked
from .shared import SPACES, as_bytes, slices, small_batches, text_or_empty

#: A run has so many periods at least.
EXPONENT = 3
Run = tuple[int, int, int]


def doubled(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols or more, the rank of each (with a last one below all), and the places in that order whose suffixes
    agree with a neighbour in as many."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    keys = symbols[order]
    first = np.r_[True, keys[1:] != keys[:-1]][:n]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    places = np.flatnonzero(~(first & np.r_[first[1:], True][:n])).astype(np.int32)
    step = 1
    while len(places) and step < depth:
        suffixes = order[places]
        groups, follow = rank[suffixes], rank[np.minimum(suffixes + step, n)]
        by = np.argsort((groups.astype(np.int64) << 32) | (follow + 1), kind="stable")
        suffixes, groups, follow = suffixes[by], groups[by], follow[by]
        order[places] = suffixes
        first = np.r_[True, (groups[1:] != groups[:-1]) | (follow[1:] != follow[:-1])]
        rank[suffixes] = np.maximum.accumulate(np.where(first, places, 0))
        places = places[~(first & np.r_[first[1:], True])]
        step *= 2
    return order, rank, places


def previous_factors(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each position, the length of the longest substring that starts there and also starts before it, and where it then starts (-1: nowhere)."""
    n = len(symbols)
    order, rank, _ = doubled(symbols, n)
    common = [0, *walked(symbols, order, rank).tolist()] if n else []
    places, lengths, sources = order.tolist(), [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # positions that rise, with what each shares with the one below it
    for p, shared in zip(places, common, strict=True):
        while stack and stack[-1][0] > p:
            q, below = stack.pop()
            if shared > lengths[q]:  # what stands next to it among the later suffixes
                lengths[q], sources[q] = shared, p
            shared = min(shared, below)
        if stack and shared:
            lengths[p], sources[p] = shared, stack[-1][0]
        stack.append((p, shared))
    return lengths, sources


def agreement(s: list[int]) -> list[int]:
    """The Z function: how many symbols from each position on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(x: list[int], b: int, before: int, after: int, least: int) -> Iterator[Run]:
    """(start, end, period) of the stretches that cut or touch the border ``b`` of blocks of ``before`` and ``after`` words, and end by the end of the second.
    ``x`` ends with a symbol of its own. The work is in proportion to the two blocks."""
    n, end = len(x) - 1, b + after
    near, far = x[b : min(end, n) + 1], x[b - before : min(end, n) + 1]
    forth = agreement([*near, -2, *far])
    reach = max(before + after, 2 * before) + 1
    low = max(0, b - reach)
    back = x[low:b][::-1]
    beyond = agreement([*back, -2, *x[low:end][::-1]])
    for q in range(1, after + 1):  # a period or more lies after the border
        right = forth[q]
        if q + right > after and end < n:
            continue  # goes on beyond the second block
        left = beyond[len(back) + 1 + after - q]
        length = left + q + right
        if length >= least and length >= EXPONENT * q and (left < len(back) or not low):
            yield b - left, b + q + right, q
    for q in range(1, before + 1):  # a period or more lies before it
        right = forth[len(near) + 1 + before - q]
        if right > after and end < n:
            continue
        left = beyond[q] if q < len(back) else 0
        length = left + q + right
        if length >= least and length >= EXPONENT * q and (left + q < len(back) or not low):
            yield b - q - left, b + right, q


def runs_of(symbols: list[int], lengths: list[int], sources: list[int], least: int) -> list[Run]:
    """(start, length, period) of all runs of one document, by start and period. ``sources`` count from its first word."""
    n, x = len(symbols), [*symbols, -1]
    starts = [0]
    while starts[-1] < n:
        starts.append(starts[-1] + max(1, lengths[starts[-1]]))
    periods: dict[tuple[int, int], int] = {}
    for i in range(1, len(starts)):
        b = starts[i]
        before, after = b - starts[i - 1], starts[i + 1] - b if i + 1 < len(starts) else 0
        if EXPONENT * (before + after) > (EXPONENT - 1) * least:
            for s, e, q in at_border(x, b, before, after, least):
                if q < periods.get((s, e), n + 1):
                    periods[s, e] = q
    if not periods:
        return []
    buckets: dict[int, dict[int, int]] = {}
    for (s, e), q in periods.items():
        buckets.setdefault(s, {})[e] = q
    for f, g in zip(starts, starts[1:], strict=False):
        if g - f <= least + 1:
            continue
        source = sources[f]
        shift = f - source
        for s in range(source + 1, g - shift - least):
            for e, q in list(buckets.get(s, {}).items()):
                if e + shift < g:
                    buckets.setdefault(s + shift, {})[e + shift] = q
    return sorted((s, e - s, q) for s, at in buckets.items() for e, q in at.items())


def found(words: list[list[bytes]], least: int) -> list[list[Run]]:
    """The runs of each document."""
    out: list[list[Run]] = [[] for _ in words]
    ids: dict[bytes, int] = {}
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((ids.setdefault(w, len(ids)) for doc in words for w in doc), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(words)), counts + 1)
    symbols = np.empty(len(doc), np.int64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(doc), bool)
    inside[ends] = False
    symbols[inside] = flat * len(words) + doc[inside]
    symbols[ends] = len(ids) * len(words) + np.arange(len(words))  # each document ends with a symbol of its own
    depth = least * (EXPONENT - 1) // EXPONENT
    order, _, places = doubled(symbols, depth)
    suspect = np.unique(doc[order[places]])
    if not len(suspect):
        return out
    kept = np.isin(doc, suspect)
    lengths, sources = previous_factors(symbols[kept])
    of = symbols[kept].tolist()
    at = 0
    for i in suspect:
        end = at + int(counts[i])
        own = lengths[at:end]
        if max(own, default=0) >= depth:
            out[i] = runs_of(of[at:end], own, [s - at for s in sources[at:end]], least)
        at = end + 1
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds beyond its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
    return b" ".join(words)


def periodic(docs: DataFrame, least: int = 24) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                words = [t.split() for t in texts]
                runs = found(words, least)
                told = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs]
                short = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.list_(one)), pa.array(short, pa.binary())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; of ties the smallest start, then period. Null if there is none."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(F.col(runs), F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def planted(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on: by their doc_id, and alike in every run. Without a doc_id a text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / one_in).alias("g"), F.when(h % one_in == 0, F.filter(F.split(text_or_empty(), SPACES), lambda w: w != "")).alias("words"))
    n, a, p = F.size("words").cast("long"), F.col("a"), F.col("p")
    cut = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    whole = lambda c: c.cast("int")
    over = F.flatten(F.array_repeat(F.slice("words", whole(a + 1), whole(p)), whole(F.ceil((n - a) / p))))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), whole(a)), F.slice(over, F.lit(1), whole(n - a))), " ")
    return cut.select("doc_id", F.when(a.isNotNull(), made).otherwise(F.col("text")).alias("text"))
