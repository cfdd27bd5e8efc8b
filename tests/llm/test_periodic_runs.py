"""Runs against a version that tries every start and period."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import periodic_runs
from palimpsest.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x: list, least: int = 24) -> list[tuple[int, int, int]]:
    """Stretches of each period; of a stretch that has several, the smallest."""
    n, found = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made_periodic(doc_id, words: list[str]) -> list[str]:
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def plain_row(doc_id, text: str | None, limit: int = 3000) -> tuple:
    words = made_periodic(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda x: sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *told, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(kept))


def ours(docs: list[list], least: int = 24) -> list[list]:
    return periodic_runs.found([[str(w).encode() for w in d] for d in docs], least)


@settings(max_examples=400, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), least=st.sampled_from([3, 4, 6, 9, 24]))
def test_random_words(docs, least):
    assert ours(docs, least) == [plain_runs(d, least) for d in docs]


@settings(max_examples=300, deadline=None)
@given(seed=st.integers(0, 2**32), least=st.sampled_from([3, 6, 24]))
def test_nested_and_copied_runs(seed, least):
    """Texts put together from copies of their own parts and powers of short ones, so that whole blocks hold runs."""
    rng = np.random.default_rng(seed)
    x: list[int] = rng.integers(0, 3, 4).tolist()
    while len(x) < 250:
        a, b = sorted(rng.integers(0, len(x) + 1, 2).tolist())
        x += x[a:b] * int(rng.integers(1, 6)) if b - a < 25 else x[a:b]
        x += rng.integers(0, 4, int(rng.integers(0, 3))).tolist()
    assert ours([x, x[::-1]], least) == [plain_runs(x, least), plain_runs(x[::-1], least)]


def test_known_words():
    one, two = ["la"] * 24, ["a", "b"] * 12
    assert ours([one, one[:-1], two, [], ["x"]]) == [[(0, 24, 1)], [], [(0, 24, 2)], [], []]
    inner = ["a"] * 24 + ["b"]
    assert ours([inner * 3]) == [plain_runs(inner * 3)] and len(plain_runs(inner * 3)) == 4
    assert periodic_runs.collapsed([b"a", *[b"b"] * 24, b"c"], [(1, 24, 1)]) == b"a b c"


@pytest.mark.parametrize("words", ["fibonacci", "thue"])
def test_words_of_many_squares(words):
    a, b = "a", "ab"
    for _ in range(13):
        a, b = b, b + a
    x = list(b) if words == "fibonacci" else [str(i.bit_count() % 2) for i in range(1500)]
    assert ours([x], 3) == [plain_runs(x, 3)]


def test_long_repetition_is_linear():
    """A million words of one kind, and of a long period, in seconds."""
    import time

    began = time.process_time()
    assert ours([["la"] * 500_000]) == [[(0, 500_000, 1)]]
    x = list(range(100_000)) * 4
    assert ours([x]) == [[(0, 400_000, 100_000)]]
    assert time.process_time() - began < 60


@pytest.mark.parametrize("name", ["hostile", "empty"])
def test_query_rows(spark, request, name, tmp_path):
    table = request.getfixturevalue(name)
    table.where("length(text) < 20000 or text is null").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect())


def test_query_on_documents(spark, docs):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in docs.collect()}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 10


def test_planted_ends(spark):
    """Chosen documents of every length up to 40 words, white space at both ends."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:120]
    rows = [(d, " \t" + "  ".join(f"w{k}" for k in range(i % 40)) + "\n") for i, d in enumerate(ids)]
    got = {r["doc_id"]: r["text"].split() for r in periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: made_periodic(i, t.split()) for i, t in rows}
