"""Quality rules by suffix arrays.

Each text is a sequence of words. A suffix array over the words of a slice of documents (each document ended by
a symbol of its own, and words of different documents being different symbols) is refined by prefix doubling;
the longest-common-prefix array then shows, for each word, the longest repeat that starts there: a maximal repeated substring
is the prefix that an interval of the array has in common. Their spans are united, and a document is rejected if repeats cover
too much of it or one repeat is too long.

Defined results: a null or empty text has no words, so it fails the base rule (fewer than ``min_words``).
A text may be of any length; it is never cut, and takes about 60 bytes of memory a word. Shares that equal a limit pass. Repeated
rows, or rows that repeat a doc_id, each get their own verdict; a null doc_id is kept. An empty table gives no rows. Other
columns, whatever their names, are passed on untouched by ``clean`` and ignored by ``verdicts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import as_bytes, by_place, lean, slices, small_batches

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """``window``: words of the shortest repeat that counts. Shares are in percent."""

    min_words: int = 10
    window: int = 5
    repeat_words_pct: int = 20
    covered_chars_pct: int = 30
    longest_repeat: int = 100


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, longest_repeat long, covered_chars long, kept boolean"


#: Up to so many symbols the ranks of all doublings are kept; above, common prefixes are found by a walk that needs two arrays.
KEPT_RANKS = 1 << 20


def longest_repeats(symbols: np.ndarray, kept_ranks: int = KEPT_RANKS) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and also starts elsewhere.

    Prefix doubling: ranks by the first 1, 2, 4, ... symbols; only suffixes whose rank is still shared are sorted
    again. The kept ranks then give the common prefix of neighbours in suffix order, from long to short steps.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    keys = symbols[order]
    levels: list[np.ndarray] = []
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    first = np.r_[True, keys[1:] != keys[:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    last = np.r_[first[1:], True]
    places = np.flatnonzero(~(first & last)).astype(np.int32)  # places in suffix order whose group has several suffixes
    del keys
    while len(places):
        if n <= kept_ranks:
            levels.append(rank.copy())
        suffixes = order[places]
        groups = rank[suffixes]
        follow = rank[np.minimum(suffixes + step, n)]
        by = np.argsort((groups.astype(np.int64) << 32) | (follow + 1), kind="stable")
        suffixes, groups, follow = suffixes[by], groups[by], follow[by]
        order[places] = suffixes
        first = np.r_[True, (groups[1:] != groups[:-1]) | (follow[1:] != follow[:-1])]
        rank[suffixes] = np.maximum.accumulate(np.where(first, places, 0))
        last = np.r_[first[1:], True]
        places = places[~(first & last)]
        step *= 2
    if n > kept_ranks:
        common = walked(symbols, order, rank)
        np.maximum.at(out, order[:-1], common)
        np.maximum.at(out, order[1:], common)
        return out
    if not levels:
        return out
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    left, right = order[same].astype(np.int64), order[same + 1].astype(np.int64)
    common = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][np.minimum(left + common, n)] == levels[k][np.minimum(right + common, n)]
        equal &= (left + common < n) & (right + common < n)
        common[equal] += 1 << k
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def walked(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix and the next in suffix order, by a walk in the order of the text: what a suffix shares
    with its neighbour is at most one symbol less for the suffix that starts one place later."""
    n, common, k = len(order), np.zeros(len(order) - 1, np.int32), 0
    s, place, at, told = memoryview(symbols), memoryview(rank), memoryview(order), memoryview(common)
    for i in range(n):
        p = place[i]
        if p == n - 1:
            k = 0
            continue
        j = at[p + 1]
        while i + k < n and j + k < n and s[i + k] == s[j + k]:
            k += 1
        told[p] = k
        k = k - 1 if k else 0
    return common


def measure(texts: list[bytes], limits: Limits) -> list[np.ndarray]:
    """The columns of SCHEMA for some texts, by one suffix array over all of their words."""
    n = len(texts)
    ids: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, n)
    total = int(counts.sum())
    flat = np.fromiter((ids.setdefault(w, len(ids)) for doc in words for w in doc), np.int64, total)
    lengths = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in ids), np.int64, len(ids))
    doc = np.repeat(np.arange(n), counts)
    chars = lengths[flat] if total else np.zeros(0, np.int64)
    symbols = np.full(total + n, -1, np.int64)
    at = np.arange(total) + doc
    symbols[at] = flat * n + doc
    ends = np.cumsum(counts) + np.arange(n)
    symbols[ends] = len(ids) * n + np.arange(n)  # each document ends with a symbol of its own
    longest = longest_repeats(symbols)[at]
    start = np.flatnonzero(longest >= limits.window)
    delta = np.zeros(total + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + longest[start], -1)
    covered = np.cumsum(delta[:-1]) > 0
    sums = lambda weights: np.bincount(doc, weights, minlength=n).astype(np.int64)
    repeat_words, covered_chars, word_chars = sums(covered), sums(chars * covered), sums(chars)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[start], longest[start])
    symbols_in = np.array([sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) for t in texts], np.int64)
    dup_lines = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        dup_lines[i] = len(lines) - len(set(lines))
    failed = (counts < limits.min_words) | (100 * repeat_words > limits.repeat_words_pct * counts)
    kept = ~failed & (100 * covered_chars <= limits.covered_chars_pct * word_chars) & (most <= limits.longest_repeat)
    return [counts, word_chars, symbols_in, dup_lines, repeat_words, failed, most, covered_chars, kept]


def verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and the columns of SCHEMA, one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, measure(texts, limits))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_place(docs, "doc_id", "text").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no shuffle, the text is read once."""
    small_batches(docs.sparkSession)
    at, placed = docs.columns.index("text"), by_place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(at))):
                yield pc.filter(part, pa.array(measure(texts, limits)[-1]))

    return placed.mapInArrow(lean(run), placed.schema).toDF(*docs.columns)
