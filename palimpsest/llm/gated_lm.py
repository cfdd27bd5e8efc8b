"""Scoring of whole documents by a gated recurrent language model that is trained on the corpus.

1. Spark counts the words of all training documents: each task sums its own, then they are shuffled by word.
2. Texts are read once more and kept as numbers: the ``WORDS`` most frequent words, the end, and "another word". The counts of up to ``FREQUENT`` words
   are sent to the tasks; the other words of a document meet theirs in a shuffled join.
3. The model is a gated recurrent network in numpy. A word's probability is that of its class times its own in the class, each by a softmax over the
   state; classes hold equal shares of the corpus. "Another word" is a class of its own, in which words have their smoothed shares of its count.
4. It learns in rounds, each over documents of its own that together are all of them, and each larger than the one before. In a round, every task goes on
   from the same weights over its documents, by truncated backpropagation: the state runs over all words, and the gradient of each ``window`` comes from
   all its steps. The weights of a round's tasks are averaged on the executors, by their words, as whole numbers, so that order
   makes no difference.
5. All documents are scored whole. Many run side by side, and the state is carried from window to window until a document ends.

Defined results: words are lower-cased (A-Z); a null or empty text is one end. A null doc_id counts as held out. Without any training document every word
has probability 1 by its count, and the model's are those of its start. Words are told apart by 64-bit hashes: two of a million million would share
one with a chance of 3 in 100 each. A text may be of any length and is never cut; one that is much longer than those beside it runs on alone. Repeated
rows are learned from and scored each on its own; an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import CELL, as_bytes, cells, drop, folded, keep_freed, lean, slices, small_batches, word_hashes, written

#: Words of the network, words whose counts every task holds, and classes of words.
WORDS, FREQUENT, CLASSES = 2046, 500_000, 40
OTHER, END = 0, 1
#: A task of a round has so many words at least, and there are so many tasks at most.
LEAST_WORDS, MOST_TASKS = 1_000_000, 4096
SMOOTH = 0.1
#: Weights are averaged as whole multiples of this.
UNIT = 2.0**-32


@dataclass(frozen=True)
class Round:
    """``parts`` of 64 of the documents; ``lanes`` run side by side; ``window`` steps between changes of the weights; ``rate`` of a change."""

    parts: int
    lanes: int
    window: int
    rate: float


ROUNDS = (Round(1, 16, 16, 0.03), Round(3, 32, 16, 0.03), Round(12, 64, 32, 0.02), Round(48, 128, 64, 0.01))


@dataclass(frozen=True)
class Shape:
    """``hidden`` numbers are the state."""

    hidden: int = 16
    rounds: tuple[Round, ...] = ROUNDS
    seed: int = 71


# --- counts ---


def lowered(texts: list[bytes]) -> list[np.ndarray]:
    return word_hashes([t.lower() for t in texts])


def merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(hashes)
    hashes, counts = hashes[by], counts[by]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(hash, c): how often each word stands in ``docs``. A task hands on its sums whenever it holds over ``most`` words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        held, size = [], 0
        sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def told(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], names=["hash", "c"])

        for batch in batches:
            for _, texts in slices(batch, as_bytes(batch.column(0))):
                for found in lowered(texts):
                    held.append(found)
                    size += len(found)
                if size >= most:
                    sums = merged(np.concatenate([sums[0], *held]), np.concatenate([sums[1], np.ones(size, np.int64)]))
                    held, size = [], 0
                    if len(sums[0]) >= most:
                        yield told(sums)
                        sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield told(merged(np.concatenate([sums[0], *held]), np.concatenate([sums[1], np.ones(size, np.int64)])))

    return docs.select("text").mapInArrow(lean(run), "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """``keys``: sorted hashes of the frequent words, with their counts and their numbers in the network (0: another word). ``total`` and
    ``distinct`` are those of all training tokens, ends included."""

    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    ends: int
    total: int
    distinct: int

    @cached_property
    def logs(self) -> np.ndarray:
        return np.log10(self.counts + SMOOTH)

    @cached_property
    def network_counts(self) -> np.ndarray:
        """Of another word, the end, and the network's words by their numbers."""
        out = np.zeros(int(self.ids.max(initial=END)) + 1, np.int64)
        out[self.ids[self.ids > END]] = self.counts[self.ids > END]
        out[END] = self.ends
        out[OTHER] = self.total - out.sum()
        return out

    def base(self) -> float:
        """What the counts of all tokens are divided by."""
        return self.total + SMOOTH * (self.distinct + 1)

    def others(self) -> float:
        """What the counts of other words are divided by."""
        inside = int((self.network_counts[END:] > 0).sum())
        return self.network_counts[OTHER] + SMOOTH * (self.distinct - inside + 1)


def vocabulary(counts: DataFrame, ends: int, words: int = WORDS, frequent: int = FREQUENT) -> Vocabulary:
    """Of a table (hash, c). The frequent words are all whose counts reach a bound, which a histogram over powers of two and their eighths gives."""
    step = F.floor(8 * F.log2("c"))
    told = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect()
    total, distinct = sum(r["c"] for r in told) + ends, sum(r["n"] for r in told) + (ends > 0)
    held, least = 0, None
    for r in told:
        if held + r["n"] > frequent:
            break
        held, least = held + r["n"], r["step"]
    got = counts.where(step >= (least if least is not None else 1 << 20)).toArrow()  # ``frequent`` rows at most
    keys, c = got["hash"].to_numpy().view(np.uint64), got["c"].to_numpy()
    by = np.argsort(keys)
    keys, c = keys[by], c[by]
    ids = np.zeros(len(keys), np.uint16)
    ids[np.lexsort((keys, -c))[:words]] = END + 1 + np.arange(min(words, len(keys)))
    return Vocabulary(keys, c, ids, ends, total, distinct)


# --- texts as numbers ---

ROW = "held_out boolean, part int, ids binary, n long, n_other long, known long, base double, other double, rare array<long>, times array<long>"


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Written: key (a number of the row's own), doc_id and ROW. ``base`` and ``other`` are sums of log10(c + 0.1), of the frequent words and of those that are other
    words for the network; ``rare`` are the words that aren't frequent."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        v = shared.value
        end_log = float(np.log10(v.ends + SMOOTH))
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(3))):
                found = lowered(texts)
                n = np.array([len(x) for x in found], np.int64)
                flat, doc = np.concatenate(found), np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(v.keys, flat), max(len(v.keys) - 1, 0))
                hit = v.keys[at] == flat if len(v.keys) else np.zeros(len(flat), bool)
                ids = np.zeros(len(flat) + len(n), np.uint16)
                ends = np.cumsum(n + 1) - 1
                ids[ends] = END
                inside = np.ones(len(ids), bool)
                inside[ends] = False
                own = np.zeros(len(flat), np.uint16)
                own[hit] = v.ids[at[hit]]
                ids[inside] = own
                logs = np.zeros(len(flat))
                logs[hit] = v.logs[at[hit]]
                sums = lambda w, doc=doc, n=n: np.bincount(doc, w, minlength=len(n))
                rare, of = flat[~hit], doc[~hit]
                by = np.lexsort((rare, of))
                rare, of = rare[by], of[by]
                first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])][: len(rare)])
                times = np.diff(np.r_[first, len(rare)])
                starts = pa.array(np.searchsorted(of[first], np.arange(len(n) + 1)).astype(np.int32))
                places = np.r_[0, 2 * (ends + 1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(ids)]),
                        pa.array(n + 1), pa.array(sums(own == OTHER).astype(np.int64)), pa.array(sums(hit).astype(np.int64) + (v.ends > 0)), pa.array(sums(logs) + end_log), pa.array(sums(logs * (own == OTHER))),
                        pa.ListArray.from_arrays(starts, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(starts, pa.array(times)),
                    ],
                    names=["doc_id", *(x.split()[0] for x in ROW.split(", "))],
                )

    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(64)).cast("int")
    rows = docs.select("doc_id", held_out().alias("held_out"), part.alias("part"), "text").mapInArrow(lean(run), f"doc_id {kind}, {ROW}")
    return written(rows.select(F.monotonically_increasing_id().alias("key"), "*"), "encoded")


# --- the network ---


def classes(counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """Where each class of numbers starts, and the end: another word, the end, then words with equal shares of the rest."""
    rest = counts[END + 1 :].astype(np.float64)
    if not len(rest):
        return np.array([0, 1, 2])
    before = np.cumsum(rest) - rest
    of = np.minimum((before / rest.sum() * most).astype(np.int64), most - 1)
    return np.r_[0, 1, 2 + np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(counts)]


class Network:
    """The weights as one array and its parts: what each word adds to the gates (reset, update, state), the recurrent matrix, classes and words,
    these two with their bias as the last column."""

    def __init__(self, counts: np.ndarray, shape: Shape, flat: np.ndarray | None = None) -> None:
        n, h = len(counts), shape.hidden
        self.shape, self.starts = shape, classes(counts)
        k = len(self.starts) - 1
        self.of = np.repeat(np.arange(k), np.diff(self.starts)).astype(np.uint8)
        sizes = [(3 * h, n), (3 * h, h), (k, h + 1), (n, h + 1)]
        length = sum(int(np.prod(s)) for s in sizes)
        self.flat = np.zeros(-(-length // CELL) * CELL, np.float32) if flat is None else flat
        self.sizes = sizes
        self.words, self.turn, self.by_class, self.by_word = self.parts(self.flat)
        self.to_class, self.class_bias = self.by_class[:, :h], self.by_class[:, h]
        self.to_word, self.word_bias = self.by_word[:, :h], self.by_word[:, h]
        if flat is None:
            rng = np.random.default_rng(shape.seed)
            self.words[:] = rng.normal(0, 0.3, self.words.shape)
            self.turn[:] = rng.normal(0, h**-0.5, self.turn.shape)
            some = np.maximum(counts, SMOOTH)
            self.word_bias[:] = np.log(some)
            self.class_bias[:] = np.log(np.add.reduceat(some, self.starts[:-1]))
            self.class_bias -= self.class_bias.max()

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.sizes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def run(self, before: np.ndarray, state: np.ndarray, kept: Kept | None = None) -> np.ndarray:
        """States (steps, hidden, lanes) after each of the words that follow ``before`` (steps, lanes); ``state`` is brought forward. An end before a word
        starts from nothing. With ``kept``, what the gradient needs stays in it."""
        h = self.shape.hidden
        t, lanes = before.shape
        out = np.empty((t, h, lanes), self.flat.dtype)
        here = kept or Kept.of(1, h, lanes, out.dtype)
        fresh = before == END
        some = fresh.any(axis=1).tolist()
        turn = self.turn.copy()
        turn[: 2 * h] *= -1  # of the gates 1 / (1 + exp(-x)) is taken
        was = state
        for i in range(t):
            at = i if kept else 0
            a, turned, new, apart = here.gates[at], here.turned[at], here.new[at], here.apart[at]
            if some[i]:
                was = was.copy()
                was[:, fresh[i]] = 0
            if kept:
                here.was[at] = was
            own = self.words.take(before[i], axis=1)
            np.matmul(turn, was, out=turned)
            np.subtract(turned[: 2 * h], own[: 2 * h], out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            np.multiply(a[:h], turned[2 * h :], out=new)
            new += own[2 * h :]
            np.tanh(new, out=new)
            np.subtract(was, new, out=apart)
            was = np.multiply(apart, a[h:], out=out[i])
            was += new
        state[:] = was
        return out

    def steps(self, before: np.ndarray, state: np.ndarray) -> np.ndarray:
        """``run`` as (hidden, steps, lanes), a view of a row for each word."""
        return np.ascontiguousarray(self.run(before, state).transpose(0, 2, 1)).transpose(2, 0, 1)

    def told(self, states: np.ndarray, after: np.ndarray, slope: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The logarithm of each word's probability (of another word: of its class), and the slope of their mean in the states, (hidden, words) each. With
        ``slope``, that in the weights is set in its parts, which hold zeros."""
        h, m = len(states), len(after)
        of = self.of[after]
        by = np.argsort(of, kind="stable")
        rows = np.ones((m, h + 1), states.dtype)
        rows[:, :h] = np.ascontiguousarray(states.T).take(by, axis=0)
        after, of = after[by].astype(np.int64), of[by].astype(np.int64)
        k = len(self.by_class)
        x = np.empty((m, k), states.dtype)
        first = k * np.arange(m)
        logs, share = self._shares([(rows, self.by_class, x)], x.reshape(-1), first, np.full(m, k), first + of)
        back = None
        if slope is not None:
            np.matmul(x.T, share * rows, out=slope[2])
            back = x @ self.to_class
            back *= share
        sizes = np.diff(self.starts)
        cut = np.searchsorted(of, np.arange(k + 1))
        held = np.flatnonzero((sizes > 1) & (cut[1:] > cut[:-1])).tolist()
        if held:  # in a class of one word its share is 1
            inside = np.flatnonzero(sizes[of] > 1)
            length = sizes[of[inside]]
            first = np.cumsum(length) - length
            own = first + after[inside] - self.starts[of[inside]]
            x = np.empty(int(length.sum()), states.dtype)
            blocks, at = [], 0
            for i in held:
                a, b, lo, hi = cut[i], cut[i + 1], self.starts[i], self.starts[i + 1]
                n = (b - a) * (hi - lo)
                blocks.append((rows[a:b], self.by_word[lo:hi], x[at : at + n].reshape(b - a, hi - lo)))
                at += n
            more, share = self._shares(blocks, x, first, length, own)
            logs[inside] += more
            if slope is not None:
                scaled = share * rows[inside]
                share /= m / len(inside)
                scaled /= m / len(inside)
                own_back = np.empty((len(inside), h), states.dtype)
                at = 0
                for i, (some, weights, y) in zip(held, blocks, strict=True):
                    end = at + len(some)
                    np.matmul(y.T, scaled[at:end], out=slope[3][self.starts[i] : self.starts[i + 1]])
                    np.matmul(y, weights[:, :h], out=own_back[at:end])
                    at = end
                own_back *= share
                back[inside] += own_back
        out = np.empty_like(logs)
        out[by] = logs
        if back is None:
            return out, None
        undone = np.empty_like(back)
        undone[by] = back
        return out, undone.T

    @staticmethod
    def _shares(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, first: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax over stretches of ``x``, which the blocks (rows, weights, their part of x) fill: the logarithm of the share at ``own`` of each stretch. ``x`` is
        left so that times the second result it is the slope of the mean loss: what all of a stretch share is not multiplied out."""

        def filled() -> np.ndarray:
            for rows, weights, y in blocks:
                np.matmul(rows, weights.T, out=y)
            return x[own]

        def summed() -> np.ndarray:
            np.exp(x, out=x)
            return np.concatenate([y @ np.ones(y.shape[1], x.dtype) for _, _, y in blocks])

        logs = filled()
        with np.errstate(over="ignore"):
            sums = summed()
        if not (sums.min() > 1e-30 and sums.max() < 1e30):  # beyond what exp can hold: the greatest of each stretch is taken off
            filled()
            top = np.maximum.reduceat(x, first)
            x -= np.repeat(top, length)
            sums = summed()
            logs -= top
        x[own] -= sums
        logs -= np.log(sums)
        return logs, (1 / (sums * len(sums)))[:, None].astype(x.dtype)

    def slope(self, before: np.ndarray, after: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The slope of the mean loss over (steps, lanes) of words, in all weights; ``state`` is brought forward."""
        h = self.shape.hidden
        t, lanes = before.shape
        kept = Kept.of(t, h, lanes, self.flat.dtype)
        states = np.ascontiguousarray(self.run(before, state, kept).transpose(0, 2, 1)).reshape(-1, h)
        flat = np.zeros_like(self.flat)
        parts = self.parts(flat)
        back = self.told(states.T, after.ravel(), parts)[1]
        back = np.ascontiguousarray(back.T.reshape(t, lanes, h).transpose(0, 2, 1))
        reset, update = kept.gates[:, :h], kept.gates[:, h:]
        # what the slope of a state is multiplied by: state, reset, update, state as the recurrent matrix gives it
        by = np.empty((t, 4, h, lanes), flat.dtype)
        np.multiply(kept.new, kept.new, out=by[:, 0])
        np.subtract(1, by[:, 0], out=by[:, 0])
        by[:, 0] *= 1 - update
        np.multiply(by[:, 0], reset, out=by[:, 3])
        np.multiply(by[:, 3], kept.turned[:, 2 * h :], out=by[:, 1])
        by[:, 1] *= 1 - reset
        np.multiply(kept.apart, update, out=by[:, 2])
        by[:, 2] *= 1 - update
        d = np.zeros((h, lanes), flat.dtype)
        earlier = np.empty_like(d)
        fresh = before == END
        some = fresh.any(axis=1).tolist()
        turn = np.ascontiguousarray(self.turn.T)
        turned = by.reshape(t, 4 * h, lanes)[:, h:]
        for i in range(t - 1, -1, -1):
            d += back[i]
            by[i] *= d
            d *= update[i]
            np.matmul(turn, turned[i], out=earlier)
            d += earlier
            if some[i]:
                d[:, fresh[i]] = 0
        np.sum(np.matmul(turned, kept.was.transpose(0, 2, 1)), axis=0, out=parts[1])
        ids = before.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        gates = by[:, [1, 2, 0]].transpose(1, 2, 0, 3).reshape(3 * h, -1)
        parts[0][:, ids[first]] = np.add.reduceat(gates.take(order, axis=1), first, axis=1)
        return flat


@dataclass
class Kept:
    """What the gradient needs of each step: gates (reset, update), what the recurrent matrix gave, the new state, the state before, and that less the new one."""

    gates: np.ndarray
    turned: np.ndarray
    new: np.ndarray
    was: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(t: int, h: int, lanes: int, kind: np.dtype) -> Kept:
        return Kept(*(np.empty((t, n * h, lanes), kind) for n in (2, 3, 1, 1, 1)))


class Learner:
    """Steps of the network's weights along slopes, each weight at a pace of its own (moments of the slope)."""

    #: Weights that are changed at once, so that they and their moments stay in the processor's cache.
    BLOCK = 1 << 14

    def __init__(self, net: Network, turn: Round) -> None:
        self.net, self.turn, self.count = net, turn, 0
        self.first, self.second = np.zeros_like(net.flat), np.zeros_like(net.flat)

    def step(self, slope: np.ndarray) -> None:
        self.count += 1
        norm = float(np.sqrt(slope @ slope))
        pace = self.turn.rate * min(1.0, self.count / 10) * (1 - 0.99**self.count) ** 0.5 / (1 - 0.9**self.count)
        for at in range(0, len(slope), self.BLOCK):
            part = slice(at, at + self.BLOCK)
            own, first, second = slope[part], self.first[part], self.second[part]
            own *= 0.1 / max(norm, 1)
            first *= 0.9
            first += own
            own *= own  # a hundredth of the square
            second *= 0.99
            second += own
            np.sqrt(second, out=own)
            own += 1e-7
            np.divide(first, own, out=own)
            own *= pace
            self.net.flat[part] -= own

    def stream(self, ids: np.ndarray) -> None:
        """Learns from all words of documents one after another: their numbers are cut into lanes, and the state runs along each; what is left, fewer words than lanes, comes
        last, in a lane of its own."""
        shape, window = self.net.shape, self.turn.window
        lanes = min(self.turn.lanes, -(-len(ids) // window))
        length = len(ids) // lanes
        if not length:
            return
        after = ids[: lanes * length].reshape(lanes, length).T
        before = np.r_[np.uint16(END), ids[: lanes * length - 1]].reshape(lanes, length).T
        state = np.zeros((shape.hidden, lanes), np.float32)
        for at in range(0, length, window):
            end = min(length, at + window)
            self.step(self.net.slope(before[at:end], after[at:end], state))
        rest = ids[lanes * length :, None]
        if len(rest):
            self.step(self.net.slope(ids[lanes * length - 1 : -1, None], rest, np.zeros((shape.hidden, 1), np.float32)))


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents of a binary column, and where each starts."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint16, (at[-1] - at[0]) // 2, at[0]) if data and at[-1] > at[0] else np.zeros(0, np.uint16), (at - at[0]) // 2


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Batches (key, ids) in groups of about ``most`` words: their keys, ids, and where each document starts."""
    keys: list[pa.Array] = []
    ids: list[np.ndarray] = []
    places: list[np.ndarray] = []
    size = 0
    for batch in batches:
        own, at = numbers(batch.column(1))
        keys.append(batch.column(0))
        ids.append(own.copy())
        places.append(at[:-1] + size)
        size += len(own)
        if size >= most:
            yield keys, np.concatenate(ids), np.concatenate([*places, [size]])
            keys, ids, places, size = [], [], [], 0
    if keys:
        yield keys, np.concatenate(ids), np.concatenate([*places, [size]])


def trained(rows: DataFrame, vocab: Vocabulary, shape: Shape = Shape(), group: int = 1 << 21) -> np.ndarray:
    """The weights after all rounds over ``rows`` (part, ids, n), an encoded table of training documents."""
    spark = rows.sparkSession
    small_batches(spark)
    net = Network(vocab.network_counts, shape)
    sizes = dict(rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # 64 rows
    low = 0
    for turn in shape.rounds:
        words = sum(n for part, n in sizes.items() if low <= part < low + turn.parts)
        if words:
            start = spark.sparkContext.broadcast(net.flat)
            counts = vocab.network_counts

            def run(batches: Iterator[pa.RecordBatch], start=start, counts=counts, turn=turn, words=words) -> Iterator[pa.RecordBatch]:
                keep_freed()
                own = Network(counts, shape, start.value.copy())
                learner, seen = Learner(own, turn), 0
                for _, ids, _ in gathered(batches, group):
                    learner.stream(ids)
                    seen += len(ids)
                if seen:  # whole numbers: the sum over all tasks is alike in any order
                    yield cells(np.rint(own.flat.astype(np.float64) * (seen / words / UNIT)).astype(np.int64))

            tasks = max(1, min(MOST_TASKS, words // LEAST_WORDS))
            some = rows.where(F.col("part").between(low, low + turn.parts - 1)).select("key", "ids").coalesce(tasks)
            summed = folded(some.mapInArrow(lean(run), "cell int, part binary"), len(net.flat), "i8", np.add)
            net = Network(vocab.network_counts, shape, (summed * UNIT).astype(np.float32))
            start.unpersist()
        low += turn.parts
    return net.flat


def likelihoods(net: Network, ids: np.ndarray, places: np.ndarray, lanes: int = 256, window: int = 64) -> np.ndarray:
    """The natural logarithm of each document's probability. Documents are dealt out to lanes, the longest first; the state of each is carried over windows."""
    n = len(places) - 1
    out = np.zeros(n)
    lengths = np.diff(places)
    loads = [(0, i) for i in range(min(lanes, n))]
    dealt: list[list[int]] = [[] for _ in loads]
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, i = heapq.heappop(loads)
        dealt[i].append(d)
        heapq.heappush(loads, (load + int(lengths[d]), i))
    streams = [np.concatenate([ids[places[d] : places[d + 1]] for d in own]) for own in dealt]
    owners = [np.repeat(np.array(own, np.int32), lengths[own]) for own in dealt]
    by = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    streams, owners = [np.r_[np.uint16(END), streams[i]] for i in by], [owners[i] for i in by]
    state = np.zeros((net.shape.hidden, len(streams)), np.float32)
    at, alive = 0, len(streams)
    while True:
        while alive and len(streams[alive - 1]) - 1 <= at:
            alive -= 1
        if not alive:
            return out
        steps = min(window, len(streams[0]) - 1 - at)
        told = np.full((alive, steps + 1), END, np.uint16)
        doc = np.full((alive, steps), n, np.int32)
        for i in range(alive):
            part = streams[i][at : at + steps + 1]
            told[i, : len(part)] = part
            doc[i, : len(part) - 1] = owners[i][at : at + steps]
        state = np.ascontiguousarray(state[:, :alive])
        states = net.steps(np.ascontiguousarray(told[:, :-1].T), state)
        logs, _ = net.told(states.reshape(net.shape.hidden, -1), told[:, 1:].T.ravel())
        out += np.bincount(doc.T.ravel(), logs.astype(np.float64), minlength=n + 1)[:n]
        at += steps


# --- scores ---


def held_out(doc_id: str = "doc_id", of: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == 0, F.lit(True))


def scored(docs: DataFrame, shape: Shape = Shape(), group: int = 1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability): one row per row of ``docs``, by counts and a
    network that learn from the documents that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    training = docs.where(~held_out())
    counts = written(counted(training), "counts")
    vocab = vocabulary(counts, training.count())
    rows = encoded(docs, vocab)
    flat = trained(rows.where("not held_out"), vocab, shape, group)
    shared = spark.sparkContext.broadcast((vocab.network_counts, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        net = Network(shared.value[0], shape, shared.value[1])
        for keys, ids, places in gathered(batches, group):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(likelihoods(net, ids, places) / np.log(10))], names=["key", "network"])

    network = rows.select("key", "ids").mapInArrow(lean(run), "key long, network double")
    rare = rows.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "hash", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    told = rows.drop("ids", "rare", "times").join(network, "key").join(rare, "key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    out = told.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n") * float(np.log10(vocab.base()))).alias("base_score"),
        (F.col("network") + F.col("other") + rare_log - F.col("n_other") * float(np.log10(vocab.others()))).alias("score"),
    )
    made = written(out, "scores")
    drop(rows, counts)
    return made
