"""Fill-in-middle transformation by events of one automaton.

A text is cut into units: a word with the white space before it, and white space at the end. An Aho-Corasick automaton over the whole text
reports the only characters that matter: the six ASCII white space characters, where the class of characters changes, and the
sentinels. Between two events without a gap no word stands; a gap, however long, is one word, so the units up to an event are a sum of
gaps, and the place where the k-th unit ends is a binary search over the events. Words are never listed.

The cuts, and whether and how a text is rearranged, follow from a digest of its doc_id, so a run again gives the same rows.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stay plain. A null doc_id counts as an empty
one. Rows that repeat a doc_id are cut at the same draws, each in its own text. A text may be of any length: it takes 8 bytes an event.
Bytes that aren't UTF-8 are kept as they are. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, slices, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = "\t\n\x0b\x0c\r "
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Draws:
    """``rate`` of texts in percent is rearranged, ``spm`` of those in percent with the suffix first."""

    seed: str = "42"
    rate: int = 50
    spm: int = 80


@cache
def automaton() -> ahocorasick.Automaton:
    """White space has value 0, sentinels 1."""
    made = ahocorasick.Automaton()
    for c in WHITE:
        made.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        made.add_word(s, 1)
    made.make_automaton()
    return made


class Units:
    """The units of a text: how many there are, where each ends, and whether a sentinel stands in it."""

    def __init__(self, text: str) -> None:
        events = np.fromiter((2 * end + kind for end, kind in automaton().iter(text)), np.int64)
        self.size, self.holds_sentinel = len(text), bool((events & 1).any())
        self.breaks = events[events & 1 == 0] >> 1
        gaps = np.diff(np.r_[-1, self.breaks, len(text)]) > 1
        self.words = np.cumsum(gaps)  # before each break, and in all
        trailing = bool(len(self.breaks)) and int(self.breaks[-1]) == len(text) - 1
        self.count = int(self.words[-1]) + trailing

    def end(self, k: int) -> int:
        """Where the first ``k`` units end."""
        if k == 0 or k == self.count:
            return self.size if k else 0
        return int(self.breaks[np.searchsorted(self.words, k)])


def arranged(text: bytes, doc_id: object, draws: Draws) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of prefix and middle, and the text as it is written."""
    shown = text.decode("utf-8", "surrogateescape")
    units = Units(shown)
    told = sha256(f"{draws.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or units.holds_sentinel or h3 % 100 >= draws.rate:
        return units.count, PLAIN, None, None, text
    a, b = sorted((h1 % (units.count + 1), h2 % (units.count + 1)))
    a, b = units.end(a), units.end(b)
    prefix, middle, suffix = shown[:a], shown[a:b], shown[b:]
    form = SPM if h4 % 100 < draws.spm else PSM
    out = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == SPM else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return units.count, form, a, b - a, out.encode("utf-8", "surrogateescape")


def transform(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                n, form, prefix, middle, out = zip(*(arranged(t, i, draws) for i, t in zip(part.column(0).to_pylist(), texts, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())], names=names)

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. A rearranged output holds each sentinel once: no text with a sentinel is rearranged, and none arises
    at a seam, as a sentinel starts with a character that it holds nowhere else."""
    out = F.col(output)
    before, after = (lambda x, s: F.substring_index(x, s, 1)), (lambda x, s: F.substring_index(x, s, -1))
    middle, head = after(out, MIDDLE), before(out, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(F.col(form) == PLAIN, out).when(F.col(form) == PSM, psm).otherwise(spm)
