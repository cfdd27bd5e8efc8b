"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on every document. Expectation-maximisation
over the counts of vote patterns (all documents; 3 ** labellers patterns at most) estimates the labellers'
accuracies and each pattern's posterior. The posteriors of a bounded sample are the labels of a linear scorer over
hashed byte trigrams and hashed buckets of statistics; it then scores every document.

Defined results: a null or empty text gets no votes but "too short", and is scored like any other. No labels
of people are used. Repeated rows get equal scores, null doc_ids too; a score of one half is kept. The sample is the ``SAMPLE``
distinct rows whose doc_id hashes lowest (of equal doc_ids, whose text does); it is chosen on hashes, and only its texts are moved.
A text may be of any length; it has ``DIMENSIONS`` features at most. An empty table gives no rows. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, slices, small_batches, written

#: Rows that the scorer learns from (a bounded sample), its dimensions, passes and rate.
SAMPLE, DIMENSIONS, PASSES, RATE = 4_000, 1 << 15, 4, 0.5
#: Common function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it on for was be with as by this are at or from "
    b"der die das und in den von zu mit ist ein eine des auf im "
    b"le la les de des et un une en que qui dans sur par pas du est "
    b"el los las y del se con una por para es".split()
)


#: All bytes but ASCII marks; digits count as marks here.
NOT_MARKS = bytes(b for b in range(256) if b > 127 or chr(b).isalpha())


def statistics(text: bytes) -> tuple[float, ...]:
    """Of a text: words, distinct share, share of repeats of the word before, symbols per word, capitals per letter,
    exclamation marks per word, function words per word, mean word length, share of words that are letters with at
    most one mark after them."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 9
    lower = [w.lower().strip(b".,;:!?") for w in words]
    again = sum(a == b for a, b in zip(lower, lower[1:], strict=False))
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    octets = np.frombuffer(text, np.uint8)
    upper = int(((octets >= 65) & (octets <= 90)).sum())
    letters = upper + int(((octets >= 97) & (octets <= 122)).sum())
    return (
        float(n),
        len(set(lower)) / n,
        again / n,
        symbols / n,
        upper / max(letters, 1),
        text.count(b"!") / n,
        sum(w in FUNCTION_WORDS for w in lower) / n,
        sum(map(len, words)) / n,
        sum(not w[:-1].translate(None, NOT_MARKS) for w in words) / n,
    )


def votes(s: tuple[float, ...]) -> list[int]:
    """One vote per labeller."""
    n, distinct, again, symbols, upper, marks, function, length, plain = s
    grade = lambda bad, good: -1 if bad else 1 if good else 0
    return [
        grade(symbols > 0.3, symbols < 0.05),
        grade(again > 0.15, again < 0.03),
        grade(n > 30 and distinct < 0.25, n < 300 and distinct > 0.5),
        grade(upper > 0.3, upper < 0.1),
        grade(marks > 0.2, marks < 0.02),
        grade(n > 20 and function < 0.08, function > 0.15),
        grade(length > 14 or 0 < length < 2.5, 4 < length < 9),
        grade(n < 2, n > 40),
        grade(n > 10 and plain < 0.6, plain > 0.85),
    ]


LABELLERS = 9


def pattern(v: list[int]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for each pattern, and each labeller's estimated accuracy when it votes.

    The start is a weighted count of votes; then labellers' vote distributions given the class, and posteriors, in turn.
    """
    seen = (patterns[:, None] // 3 ** np.arange(LABELLERS)) % 3
    weight = counts / max(counts.sum(), 1)
    # labellers say "bad" seldom, so one such vote weighs as five for "good" at the start
    good = 1 / (1 + np.exp(2.5 * (seen == 0).sum(axis=1) - 0.5 * (seen == 2).sum(axis=1)))
    table = np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        share = float(weight @ good)
        for c, p in enumerate((1 - good, good)):
            for k in range(LABELLERS):
                table[c, k] = np.bincount(seen[:, k], weight * p, minlength=3) + 1e-4
            table[c] /= table[c].sum(axis=1, keepdims=True)
        log = np.log(table)[:, np.arange(LABELLERS), seen].sum(axis=2) + np.log([[max(1 - share, 1e-6)], [max(share, 1e-6)]])
        then = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(then - good).max(initial=0) < 1e-9
        good = then
        if done:
            break
    right = np.array([weight @ (good * (seen[:, k] == 2) + (1 - good) * (seen[:, k] == 0)) / max(weight @ (seen[:, k] != 1), 1e-12) for k in range(LABELLERS)])
    return good, right


def features(text: bytes, s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features, of length 1."""
    octets = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams = (octets[:-2] << 16 | octets[1:-1] << 8 | octets[2:]) if len(octets) > 2 else np.zeros(0, np.uint32)
    hashed = (grams * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)
    place, count = np.unique(hashed, return_counts=True)
    value = np.log1p(count)
    value /= max(float(np.linalg.norm(value)), 1e-12)
    buckets = np.array([int(min(9, 10 * x)) if k else int(np.log2(x + 1)) for k, x in enumerate(s[:7])], np.int64)
    own = (buckets * 7919 + np.arange(7) * 104_729 + 13) % DIMENSIONS
    return np.r_[place, own], np.r_[value, np.full(len(own), 0.5)]


def train(made: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic scorer, by adaptive gradient steps in the order given; classes weigh alike."""
    w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-3)
    share = min(max(float(labels.mean()), 0.02), 0.98) if len(labels) else 0.5
    made = [(np.r_[place, DIMENSIONS], np.r_[value, 1.0]) for place, value in made]
    for _ in range(PASSES):
        for (place, value), y in zip(made, labels, strict=True):
            p = 1 / (1 + np.exp(-np.clip(w[place] @ value, -30, 30)))
            step = (p - y) * value * (0.5 * y / share + 0.5 * (1 - y) / (1 - share))
            np.add.at(g, place, step * step)
            np.subtract.at(w, place, RATE * step / np.sqrt(g[place]))
    return w


@dataclass(frozen=True)
class Model:
    """``posterior`` of "good" by vote pattern, the labellers' estimated ``accuracies``, and the scorer's ``weights``."""

    posterior: dict[int, float]
    accuracies: list[float]
    weights: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Learns from all documents' votes, and the scorer from the sample."""
    small_batches(docs.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(statistics(t))) for t in as_bytes(batch.column(0))], pa.int32())], names=["pattern"])

    counted = docs.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").count().orderBy("pattern").toPandas()
    patterns = counted["pattern"].to_numpy(np.int64)
    posterior, right = fit_labellers(patterns, counted["count"].to_numpy(np.float64))
    known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, value, label = [], [], []
            for t in as_bytes(batch.column(2)):
                s = statistics(t)
                at, x = features(t, s)
                place.append(at.astype(np.int32))
                value.append(x.astype(np.float32))
                label.append(known[pattern(votes(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(label, pa.float64())], names=["h", "t", "place", "value", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, labels = [], []
        for b in batches:
            made += [(p.astype(np.int64), v.astype(np.float64)) for p, v in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), strict=True)]
            labels += b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([train(made, np.array(labels)).tolist()], pa.list_(pa.float64()))], names=["w"])

    hashes = docs.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    chosen = written(hashes.select("h", "t").distinct().orderBy("h", "t").limit(SAMPLE), "chosen")  # narrow rows
    texts = hashes.join(F.broadcast(chosen), ["h", "t"], "left_semi").groupBy("h", "t").agg(F.first("text").alias("text"))
    sample = written(texts.select("h", "t", "text").mapInArrow(featured, "h long, t long, place array<int>, value array<float>, label double"), "sample")
    first = written(sample.orderBy("h", "t").select("place", "value", "label").coalesce(1).mapInArrow(learn, "w array<double>"), "weights").first()
    return Model(known, right.tolist(), np.array(first["w"] if first else np.zeros(DIMENSIONS + 1)))


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, votes_good, votes_bad, posterior, score, kept: one row per row of ``docs``, by a model of its own unless one is given."""
    spark, model = docs.sparkSession, model or fit(docs)
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((model.posterior, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                rows = []
                for t in texts:
                    s = statistics(t)
                    v = votes(s)
                    place, value = features(t, s)
                    p = 1 / (1 + np.exp(-np.clip(w[place] @ value + w[DIMENSIONS], -30, 30)))
                    rows.append((v.count(1), v.count(-1), known.get(pattern(v)), float(p), bool(p >= 0.5)))
                good, bad, post, p, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(good, pa.int32()), pa.array(bad, pa.int32()), pa.array(post, pa.float64()), pa.array(p, pa.float64()), pa.array(kept)], names=["doc_id", "votes_good", "votes_bad", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, votes_good int, votes_bad int, posterior double, score double, kept boolean")
