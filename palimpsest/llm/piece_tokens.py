"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

A segment starts as its characters. The agenda holds each adjacent pair that makes a piece; the pair of the best score
(of equal ones the leftmost) is merged, and its neighbours' pairs take its place, until no pair is left.
Short segments are merged many at a time: a row per segment, its agenda an array of ranks. Long ones have a heap.
Symbols that are no pieces fall back to byte pieces.

Where no piece continues across a space or another character, or holds two characters side by side (learned from the
vocabulary), merges can't either; so texts are cut there, and each distinct segment is encoded and decoded once per Python
worker, in a bounded memory. In every Arrow batch the first text and others, chosen by their own hash, are checked whole
against the library, ids and decoded text; a difference fails the task.

Defined results: a null text is empty and has no ids; an empty table gives no rows. A text may be of any length, spaces or
not: a long segment that can't be cut takes about 60 bytes of memory a character. Rows that repeat others, or a doc_id, get
results of their own; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import as_bytes, slices, small_batches

SPACE = "▁"
#: Longest segment that is merged in rows; of so many texts, one is checked against the library.
ROW, CHECKED_OF = 48, 64
NEVER = np.int32(2**31 - 1)


class Coded(NamedTuple):
    """Of a segment: its ids, their number, their decimal text, and the text that they decode to, leading space included."""

    ids: tuple[int, ...]
    count: int
    digits: bytes
    text: bytes


class Pieces:
    """The vocabulary: ids of symbols, and for each pair of symbols the piece it makes and its rank."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.most = sp.get_piece_size(), most
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.symbols = dict(self.ids)  # and characters that occur in pieces only
        for piece in self.ids:
            for c in piece:
                self.symbols.setdefault(c, len(self.symbols) + n)
        scores = np.array([sp.get_score(i) for i in range(n)])
        ranks = np.unique(-scores, return_inverse=True)[1]
        pairs: dict[tuple[int, int], int] = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.pairs, self.rank = pairs, ranks.astype(np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.names = {i: p for p, i in self.ids.items()}
        # a space begins a segment if pieces have spaces at their start only; a character that no longer piece has is one
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        own = "".join(c for c in "\n\t\r" if c not in inside)
        body = f"[^{SPACE}{own}]" if own else f"[^{SPACE}]"
        self.pattern = re.compile(f"{SPACE}*{body}+|{SPACE}+" + (f"|[{own}]" if own else ""))
        beside = {(ord(a) << 21) | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.int64)
        self.known: dict[str, Coded] = {}

    def _ids_of(self, symbols: list[int], chars: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s, text in zip(symbols, chars, strict=True):
            if s in self.names:
                out.append(s)
            else:
                out += [self.bytes[b] for b in text.encode()]
        return tuple(out)

    def merge_heap(self, segment: str) -> tuple[int, ...]:
        """The agenda of a long segment: the pairs of its characters in order of (rank, place), and a heap of those that merges
        have made since; an entry that is no longer true is passed over. Arrays of numbers only, as segments may be long."""
        codes = np.frombuffer(segment.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        symbol = np.array([self.symbols.get(chr(c), -1) for c in distinct], np.int64)[inverse]
        n = len(symbol)
        rank = self._made_of(symbol[:-1], symbol[1:])[0] if n > 1 else np.zeros(0, np.int32)
        first = np.flatnonzero(rank != NEVER)
        first = first[np.argsort(rank[first], kind="stable")]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        made: list[int] = []
        at = 0

        def piece_at(i: int) -> int | None:
            j = after[i]
            return self.pairs.get((int(symbol[i]), int(symbol[j]))) if alive[i] and j < n else None

        while at < len(first) or made:
            place = int(first[at]) if at < len(first) else -1
            if made and (place < 0 or made[0] < (int(rank[place]) << 32 | place)):
                entry = heapq.heappop(made)
            else:
                entry, at = int(rank[place]) << 32 | place, at + 1
            i = entry & 0xFFFFFFFF
            piece = piece_at(i)
            if piece is None or self.rank[piece] != entry >> 32:
                continue
            j = after[i]
            symbol[i], alive[j], after[i] = piece, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, int(before[i])):
                if k >= 0 and (new := piece_at(k)) is not None:
                    heapq.heappush(made, int(self.rank[new]) << 32 | k)
        starts = np.flatnonzero(alive)
        ends = np.r_[starts[1:], n]
        return self._ids_of(symbol[starts].tolist(), [segment[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _made_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs; NEVER where they make none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        piece = np.where(ok, self.made[at], 0)
        return np.where(ok, self.rank[piece], NEVER).astype(np.int32), piece

    def merge_rows(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Segments of one length, each a row; every round merges the best pair of each row that has one."""
        n, width = len(segments), len(segments[0])
        codes = np.array(segments, f"U{width}").view(np.uint32).reshape(n, width)
        distinct, inverse = np.unique(codes, return_inverse=True)
        symbol = np.array([self.symbols.get(chr(c), -1) for c in distinct], np.int64)[inverse.reshape(n, width)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = np.ones((n, width), bool)
        agenda = np.full((n, width), NEVER, np.int32)
        if width > 1:
            agenda[:, :-1] = self._made_of(symbol[:, :-1], symbol[:, 1:])[0]
        rows = np.arange(n)
        while True:
            i = agenda[rows].argmin(axis=1)
            some = agenda[rows, i] != NEVER
            rows, i = rows[some], i[some]
            if not len(rows):
                break
            j = after[rows, i]
            symbol[rows, i] = self._made_of(symbol[rows, i], symbol[rows, j])[1]
            live[rows, j] = False
            agenda[rows, j] = NEVER
            agenda[rows, i] = NEVER
            k = after[rows, j]
            after[rows, i] = k
            on = k < width
            before[rows[on], k[on]] = i[on]
            agenda[rows[on], i[on]] = self._made_of(symbol[rows[on], i[on]], symbol[rows[on], k[on]])[0]
            h = before[rows, i]
            on = h >= 0
            agenda[rows[on], h[on]] = self._made_of(symbol[rows[on], h[on]], symbol[rows[on], i[on]])[0]
        out = []
        plain = [s in self.names for s in range(int(symbol.max()) + 1)] if symbol.size else []
        whole = np.where(live, symbol, 0)
        good = (np.array(plain)[np.maximum(whole, 0)] | ~live).all(axis=1) & (symbol >= 0).all(axis=1) if plain else np.zeros(n, bool)
        for r in range(n):
            ids = symbol[r][live[r]].tolist()
            if good[r]:
                out.append(tuple(ids))
            else:
                starts = np.flatnonzero(live[r]).tolist()
                out.append(self._ids_of(ids, [segments[r][a:b] for a, b in zip(starts, [*starts[1:], width], strict=True)]))
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        if not self.cut_spaces:
            return self.cut(escaped)
        found = self.pattern.findall(escaped)
        if max(map(len, found)) <= ROW:
            return found
        return list(chain.from_iterable(self.cut(s) if len(s) > ROW else (s,) for s in found))

    def cut(self, segment: str) -> list[str]:
        """A long segment, cut between characters that no piece holds side by side."""
        codes = np.frombuffer(segment.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cuts = (np.flatnonzero(self.beside[at] != pair) + 1).tolist()
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)]

    def coded(self, segments: list[str], ids: list[tuple[int, ...]]) -> Iterator[Coded]:
        """What is remembered of segments; the library decodes them in one call."""
        for segment, own, text in zip(segments, ids, self.library.decode([list(x) for x in ids], num_threads=1), strict=True):
            if segment[0] == SPACE:  # the library drops one leading space
                text = " " + text
            yield Coded(own, len(own), ",".join(map(str, own)).encode(), text.encode())

    def encode(self, texts: list[str]) -> list[list[Coded]]:
        """The segments of each text."""
        cut = [self.segments(t) for t in texts]
        distinct = set(chain.from_iterable(cut))
        if len(self.known) + len(distinct) > self.most:
            self.known.clear()
        by_length: dict[int, list[str]] = {}
        for s in distinct.difference(self.known):
            by_length.setdefault(len(s), []).append(s)
        for length, new in by_length.items():
            ids = list(map(self.merge_heap, new)) if length > ROW else self.merge_rows(new)
            self.known.update(zip(new, self.coded(new, ids), strict=True))
        get = self.known.__getitem__
        return [list(map(get, own)) for own in cut]


@cache
def pieces_of(path: str) -> Pieces:
    """One vocabulary, and one memory of segments, for all tasks that a Python worker runs."""
    return Pieces(path)


def round_trip(docs: DataFrame, model: str, checked_of: int = CHECKED_OF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            first = True
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                plain = [t.decode("utf-8", "replace") for t in texts]
                count, digest, decoded = [], [], []
                for i, own in enumerate(pieces.encode(plain)):
                    ids, n, digits, text = zip(*own, strict=True) if own else ((),) * 4
                    back = b"".join(text)[1:]
                    count.append(sum(n))
                    digest.append(hashlib.sha256(b",".join(digits)).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if first or zlib.crc32(texts[i]) % checked_of == 0:
                        first, whole = False, pieces.library.encode(plain[i])
                        if whole != list(chain.from_iterable(ids)) or (whole and pieces.library.decode(whole).encode() != back):
                            raise AssertionError("the agenda and the sentencepiece library differ on a text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(digest), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
