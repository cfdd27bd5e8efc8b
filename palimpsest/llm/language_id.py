"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point, so letters of every script have their own. A letter trigram is bound into one
vector: the product of its letters' vectors, permuted (rolled) by their place. A text's vector is the bundle (sum) of its trigrams'
vectors, a language's the bundle of its documents'. A text gets the language whose prototype has the largest cosine with it.

Bundling is linear: a task counts the trigrams of its labelled documents (each document weighs alike), bundles the counts, and Spark adds the
bundles of all tasks, as whole numbers.

Defined results: ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Ties go to the
language that sorts first. A null doc_id counts as held out. Case doesn't count; runs of other characters count as one gap. A text
may be of any length. Repeated rows are learned from and predicted each on its own; an empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, by_place, mixed, slices, small_batches

DIMENSIONS, SEED = 1024, 20_001
UNKNOWN = "und"
WEIGHT = 1_000_000
#: Trigrams whose vectors are held at once (1 KB each), and distinct trigrams of a language that a task counts before it bundles them.
HELD, COUNTED = 1 << 15, 1 << 20


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of each code point (0 for a gap): the bits of 16 mixed numbers, as +1 and -1."""
    words = points.astype(np.uint64)[:, None] * np.uint64(16) + np.arange(16, dtype=np.uint64)
    bits = np.unpackbits(mixed(words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)).astype("<u8").view(np.uint8).reshape(len(points), DIMENSIONS // 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams, three code points of 21 bits each, and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, 0)
    if not points.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.r_[0, points, 0]
    points = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram: first letter rolled by two, second by one."""
    places = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF])
    points, at = np.unique(places, return_inverse=True)
    one = letter_vectors(points)
    first, second, third = at.reshape(places.shape)
    out = np.roll(one, 2, axis=1)[first]
    out *= np.roll(one, 1, axis=1)[second]
    out *= one[third]
    return out


def bundled(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, each as often as its weight. Whole numbers under 2**53 are exact."""
    out = np.zeros(DIMENSIONS)
    for i in range(0, len(codes), HELD):
        out += weights[i : i + HELD].astype(np.float64) @ trigram_vectors(codes[i : i + HELD])
    return out


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all rows of ``labelled`` (text, lang not null)."""
    small_batches(labelled.sparkSession)

    def merged(own: list[np.ndarray]) -> list[np.ndarray]:
        codes, at = np.unique(np.concatenate(own[::2]), return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, at, np.concatenate(own[1::2]))
        return [codes, sums]

    def told(lang: str, own: list[np.ndarray]) -> pa.RecordBatch:
        codes, sums = merged(own)
        values = np.r_[np.rint(bundled(codes, sums)).astype(np.int64), sums.sum()]  # the last is the weight of all
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["lang", "place", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(0))):
                for lang, text in zip(part.column(1).to_pylist(), texts, strict=True):
                    code, count = trigrams(text.decode("utf-8", "replace"))
                    if len(code):
                        held.setdefault(lang, []).extend((code, WEIGHT * count // count.sum()))
                        sizes[lang] = sizes.get(lang, 0) + len(code)
                        if sizes[lang] > COUNTED:
                            held[lang] = merged(held[lang])
                            sizes[lang] = len(held[lang][0])
                            if 2 * sizes[lang] > COUNTED:
                                yield told(lang, held.pop(lang))
                                del sizes[lang]
        for lang, own in held.items():
            yield told(lang, own)

    sums = by_place(labelled, "text", "lang").select("text", "lang").mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    got = sums.toPandas()  # 1,025 rows for each language
    names = sorted(got["lang"].unique().tolist())
    prototypes = np.zeros((len(names), DIMENSIONS))
    for i, name in enumerate(names):
        own = got[got["lang"] == name].sort_values("place")["value"].to_numpy(np.float64)
        prototypes[i] = own[:DIMENSIONS] / own[DIMENSIONS]
    return names, prototypes


def directions(prototypes: np.ndarray) -> np.ndarray:
    """Unit vectors of the prototypes, without what all languages have in common."""
    apart = prototypes - prototypes.mean(axis=0) if len(prototypes) > 1 else prototypes
    return (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: the cosine, from -1 and 1 to 0 and 1."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    mean = prototypes.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    toward = directions(prototypes) if names else prototypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, as_bytes(batch.column(1))):
                found = [trigrams(t.decode("utf-8", "replace")) if names else (np.zeros(0, np.int64),) * 2 for t in texts]
                every = np.unique(np.concatenate([code for code, _ in found]))
                vectors = trigram_vectors(every) if len(every) <= HELD else None
                lang, score = [], []
                for code, count in found:
                    if not len(code):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    if vectors is None:
                        own = bundled(code, count) / count.sum() - mean
                    else:
                        own = (count / count.sum()).astype(np.float32) @ vectors[np.searchsorted(every, code)].astype(np.float32) - mean
                    cosine = toward @ own / max(float(np.linalg.norm(own)), 1e-12)
                    best = int(np.argmax(cosine))
                    lang.append(names[best])
                    score.append(min(1.0, max(0.0, (1 + float(cosine[best])) / 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents that are not held out."""
    docs = by_place(docs, "doc_id", "text", "lang")
    names, prototypes = learn(docs.where(~held_out()).where("lang is not null"))
    return predict(docs, names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
