"""Each operator against a plain version: on the driver's small table, on hostile rows, on an empty table."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import components, exact_dedup, jaccard_join, language_id, packing, piece_tokens, plane_store, quality_repeats, shared, suffix_dedup, warc_archive, weak_labels
from palimpsest.llm.queries import QUERIES, vocabulary

WORDS, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "hostile", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


# --- 1 ---


def test_quality_rules(table):
    want = Counter((i, *brute.quality(t)) for i, t in pairs(table))
    got = quality_repeats.verdicts(table).collect()
    assert Counter(tuple(r[:6]) + (r["base_failed"],) for r in got) == want
    limits = quality_repeats.Limits()
    texts = dict(pairs(table))
    for r in got:
        if r["n_words"] < 400:
            longest = brute.longest_repeat(brute.WORD.findall(texts[r["doc_id"]] or ""))
            assert r["longest_repeat"] == (longest if longest >= limits.window else 0)
        assert r["covered_chars"] == brute.covered_chars(texts[r["doc_id"]])
        fine = 100 * r["covered_chars"] <= limits.covered_chars_pct * r["word_chars"] and r["longest_repeat"] <= limits.longest_repeat
        assert r["kept"] == (not r["base_failed"] and fine)
    kept = quality_repeats.clean(table)
    assert kept.schema == table.schema and kept.count() == sum(r["kept"] for r in got)


@pytest.mark.parametrize("kept_ranks", [0, 1 << 20])
@settings(max_examples=60, deadline=None)
@given(symbols=st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(kept_ranks, symbols):
    s = np.array(symbols, np.int64)
    got = quality_repeats.longest_repeats(s, kept_ranks)
    for i in range(len(s)):
        want = 0
        for j in range(len(s)):
            k = 0
            while i != j and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            want = max(want, k)
        assert got[i] == want


def test_quality_of_a_very_long_text():
    """Three million words, mostly one passage over and over: within half a gigabyte, and by the walk."""
    import tracemalloc

    text = b"a b c d e f g h " * 190_000 + b" ".join(b"w%d" % i for i in range(10_000))
    tracemalloc.start()
    got = quality_repeats.measure([text], quality_repeats.Limits())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0][0] == 1_530_000 and got[4][0] == 1_520_000 and got[6][0] == 1_520_000 - 8 and not got[8][0]
    assert peak < 500e6


# --- 2 ---


@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(5)
    for top in (1, 2, 255, 256, 49_407, 65_536, 2**32 - 1):
        ids = rng.integers(0, top + 1, 1003).astype("<u4")
        assert (plane_store.from_planes(plane_store.to_planes(ids, bits), len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_plane_store(spark, table, tmp_path, bits):
    path = f"file://{tmp_path}/store"
    plane_store.write(table, path, WORDS, bits=bits, block=64)
    rows = sorted(pairs(table), key=lambda r: (r[0] is not None, r[0]))
    ids = brute.token_ids([t for _, t in rows], WORDS)
    starts = np.r_[0, np.cumsum([len(x) for x in ids])].tolist()
    want = Counter((r[0], s, len(x), brute.crc(x)) for r, s, x in zip(rows, starts, ids, strict=False))
    assert Counter(map(tuple, plane_store.digests(spark, path).collect())) == want
    index = spark.read.parquet(f"{path}/index")
    assert sum(r["n_docs"] for r in index.collect()) == len(rows)


# --- 3 ---


def test_jaccard_join(table):
    rows = pairs(table)
    known = brute.jaccard_components([(i, t) for i, t in dict(rows).items() if i is not None])
    got = jaccard_join.join(table).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all((r["n_shingles"], r["component_id"]) == known[r["doc_id"]] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("short", [0, 12])
def test_jaccard_hot_group(spark, monkeypatch, short):
    """A large group of near copies, a chain of edits, small sets and others that share a passage, by pivots and by pairs."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each with one or two words of its own
        words = base.copy()
        for k in rng.integers(0, 120, 1 + i % 2):
            words[k] = f"own{i}x{k}"
        rows.append(" ".join(words))
    chain = [f"c{i}" for i in range(100)]
    for i in range(15):  # each linked with the next only
        chain = chain[:-1] if i % 2 else [*chain[:5], f"edit{i}", *chain[6:]]
        rows.append(" ".join(chain))
    passage = [f"p{i}" for i in range(80)]
    rows += [" ".join([*passage, *(f"q{i}y{k}" for k in range(10 + i % 9))]) for i in range(40)]
    for n in range(9, 30):  # small sets, with and without their last word
        small = [f"s{n}z{k}" for k in range(n + 2)]
        rows += [" ".join(small), " ".join(small[:-1]), " ".join(small[1:])]
    order = rng.permutation(len(rows))
    table = [(int(i), rows[j]) for i, j in enumerate(order)]
    want = brute.jaccard_components(table)
    got = jaccard_join.join(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 10), (10, 20), *((100 + i, 101 + i) for i in range(40))]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {2: 1, 3: 1, 4: 1, 8: 7, 9: 7, 20: 10} | {101 + i: 100 for i in range(40)}
    assert {k: v for k, v in got.items() if k != v} == want


def test_boundary_is_by_cost():
    assert jaccard_join.boundary(1000.0, 0.0, 90) < jaccard_join.boundary(1000.0, 1_000_000.0, 90)


# --- 4 ---


def test_language(spark, table):
    got = language_id.identify(table).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(table))
    for r in got:
        assert 0 <= r["score"] <= 1
    text = dict(pairs(table))
    assert all(r["lang_pred"] == "und" for r in got if not any(c.isalpha() for c in text[r["doc_id"]] or ""))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs, "doc_id").where("held_out").select("lang_pred", "lang").collect()
    assert len(got) > 250 and sum(a == b for a, b in got) / len(got) > 0.97


def test_language_like_plain(spark, docs):
    """Trigrams, bundles and cosines counted one by one in Python give the same languages and scores."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute.languages(rows)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    assert {i: g[:2] for i, g in got.items()} == {i: w[:2] for i, w in want.items()}
    assert all(abs(got[i][2] - w[2]) < 1e-3 for i, w in want.items())


def test_letters_of_all_scripts(spark):
    rows = [(1, "\U00030000\U00030001 \U00030002"), (2, "12 34"), (3, None)]
    names, prototypes = ["xx"], np.ones((1, language_id.DIMENSIONS))
    got = language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), names, prototypes).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "xx", 2: "und", 3: "und"}


def test_binding_is_by_place():
    code = lambda a, b, c: a << 42 | b << 21 | c
    one, two = language_id.trigram_vectors(np.array([code(1, 2, 3), code(3, 2, 1)])).astype(int)
    assert abs(one @ two) < 0.2 * language_id.DIMENSIONS and one @ one == language_id.DIMENSIONS


def test_letters_have_vectors_of_their_own():
    points = np.array([0, *range(0x41, 0x250), *range(0x400, 0x460), *range(0x4E00, 0x5000)])
    v = language_id.letter_vectors(points).astype(int)
    apart = v @ v.T - language_id.DIMENSIONS * np.eye(len(points), dtype=int)
    assert np.abs(apart).max() < 0.25 * language_id.DIMENSIONS
    assert v[5].tolist() == brute.letter_vector(int(points[5]))


@pytest.mark.parametrize("held", [8, language_id.HELD])
def test_two_languages_in_one_script(spark, monkeypatch, held):
    """Two invented languages in Cyrillic and two in Chinese letters, told by their letters' order alone; also where few vectors are held at once."""
    monkeypatch.setattr(language_id, "HELD", held)
    monkeypatch.setattr(language_id, "COUNTED", 50 if held == 8 else language_id.COUNTED)
    rng = np.random.default_rng(6)
    rows = []
    for script, base in (("cyr", 0x430), ("han", 0x4E00)):
        alphabet = [chr(base + i) for i in range(26)]
        for lang in range(2):
            parts = ["".join(rng.permutation(alphabet)[:3]) for _ in range(12)]
            for _ in range(60):
                words = ["".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(40)]
                rows.append((len(rows), " ".join(words), f"{script}{lang}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).join(docs, "doc_id").where("held_out").select("lang_pred", "lang").collect()
    assert len(got) > 60 and all(a == b for a, b in got)


# --- 5 ---


def check_packing(rows, table, capacity: int, slack: int) -> None:
    ids = defaultdict(list)
    for (i, _), x in zip(pairs(table), brute.token_ids([t for _, t in pairs(table)], WORDS), strict=True):
        ids[i].append(x)
    count = Counter((r["doc_id"], r["piece"]) for r in rows)
    for i, same in ids.items():
        for k in range(-(-len(same[0]) // capacity)):
            assert count.pop((i, k)) == len(same)
    assert not count
    by = defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(own) == r["length"] and brute.crc(own) == r["ids_crc32"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert len(by) <= least + slack


@pytest.mark.parametrize(("group", "slack"), [(10_000, 2), (64, 15)])
def test_packing(table, monkeypatch, group, slack):
    """In one group, two sequences over the lower bound at most; in many small ones, a few more."""
    monkeypatch.setattr(packing, "GROUP", group)
    check_packing(packing.sequences(table, WORDS, 512).collect(), table, 512, slack)


def test_local_search_beats_best_fit():
    sizes = np.random.default_rng(3).integers(1200, 2600, 2000)
    first = packing.best_fit(sizes, 4096)
    then = packing.improve(sizes, first, 4096)
    assert np.bincount(then, sizes).max() <= 4096 and len(set(then)) < len(set(first))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_local_search(sizes):
    s = np.array(sizes)
    first = packing.best_fit(s, 50)
    then = packing.improve(s, first, 50)
    for bins in (first, then):
        assert np.bincount(bins, s).max() <= 50
    assert len(set(then)) <= len(set(first))
    squares = lambda b: int((np.bincount(b, s).astype(int) ** 2).sum())
    assert squares(then) >= squares(first)


def test_local_search_empties_a_bin():
    sizes = np.array([6, 4, 4, 3, 3])
    then = packing.improve(sizes, np.array([0, 1, 1, 0, 2]), 10)
    assert len(set(then)) == 2


# --- 6 ---


def test_suffix_dedup(table):
    rows = pairs(table)
    want = brute.repeats([((n, i), t) for n, (i, t) in enumerate(rows)])
    got = suffix_dedup.removed(table).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter((i, *v) for (_, i), v in want.items())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for (_, i), t in brute.cleaned([((n, i), t) for n, (i, t) in enumerate(rows)], 400, 10**9).items())


@pytest.mark.parametrize(("seed", "pairwise", "partitions"), [(0, 24, 20_000), (1, 24, 20_000), (2, 1, 20_000), (3, 24, 2), (4, 1, 1)])
def test_suffix_dedup_short(spark, seed, pairwise, partitions, monkeypatch):
    """Strings of 40 bytes over a small alphabet: overlaps, periods, edges, many buckets, several of them in a partition, and long texts cut in
    stretches; groups compared pair by pair and by classes."""
    if partitions < 20_000:
        monkeypatch.setattr(suffix_dedup, "PARTITIONS", partitions)
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", 30)
        monkeypatch.setattr(suffix_dedup, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20"))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "PAIRWISE", pairwise)
    rng = np.random.default_rng(seed)
    letters = lambda n, k: "".join(rng.choice(list("abcdefgh"[:k]), n))
    shared = [letters(int(n), 8) for n in rng.integers(30, 120, 12)]
    rows = []
    for i in range(60):
        parts = [letters(int(rng.integers(0, 60)), 8)]
        for _ in range(int(rng.integers(0, 5))):
            s = shared[rng.integers(0, len(shared))]
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            parts += [s[a:b] if rng.random() < 0.6 else s, letters(int(rng.integers(0, 9)), 3)]
        rows.append((i, "".join(parts)))
    rows += [(60, "ab" * 900), (61, "a" * 300), (62, "é" * 50 + "x" + "é" * 50), (63, letters(3000, 8)), (64, None)]
    want = brute.repeats(rows, 40)
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 40).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == want


def test_suffix_clean(hostile):
    out = suffix_dedup.clean(hostile)
    assert out.columns == hostile.columns and out.count() == hostile.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[10] == ""


@pytest.mark.parametrize("seed", range(2))
def test_suffix_clean_words(spark, seed, monkeypatch):
    """Passages of words, some one word short, beside each other, with other white space between their words."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    rng = np.random.default_rng(seed)
    some = lambda n, k: [f"w{x}" if x % 5 else "é" * (x % 3 + 1) for x in rng.integers(0, k, n)]
    shared = [some(int(n), 10**6) for n in rng.integers(9, 30, 8)]
    rows = []
    for i in range(50):
        words = some(int(rng.integers(0, 12)), 10**6)
        for _ in range(int(rng.integers(0, 4))):
            s = shared[rng.integers(0, len(shared))]
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            words += (s[a:b] if rng.random() < 0.6 else s) + some(int(rng.integers(0, 3)), 10**6)
        rows.append((i, "".join(w + str(rng.choice([" ", "\n", " \t "])) for w in words)))
    rows += [(50, "a " * 40), (51, " ".join(some(400, 10**6))), (52, None), (53, ""), (54, "  ".join(["x", "y"] * 30))]
    want = brute.without_repeated_words(rows, 10)
    got = suffix_dedup.clean(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 1000, words=10).collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2)), max_size=30))
def test_multikey_order(rows):
    words = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    order, group = suffix_dedup.multikey_order(len(rows), 3, lambda k, some: words[k][some])
    assert [rows[i] for i in order] == sorted(rows)
    assert group.tolist() == [sorted(set(rows)).index(r) for r in sorted(rows)]


@pytest.mark.parametrize("words", [False, True])
def test_hot_passage_over_many_buckets(spark, words, monkeypatch):
    """A passage in most documents, with other neighbours each time, and near copies of it: as if each string were counted."""
    monkeypatch.setattr(suffix_dedup, "PAIRWISE", 4)
    rng = np.random.default_rng(8)
    own = lambda n: [f"o{x}" for x in rng.integers(0, 10**9, n)]
    passage = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(90):
        middle = passage.copy()
        if i % 3 == 1:
            middle[int(rng.integers(0, 24))] = own(1)[0]
        rows.append((i, " ".join([*own(int(rng.integers(0, 6))), *middle, *own(int(rng.integers(0, 6)))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(docs, 1000 if words else 60, 12 if words else None).collect()}
    assert got == brute.cleaned(rows, 10**9 if words else 60, 12 if words else 10**9)


# --- 7 ---


def test_weak_labels_find_accuracies():
    """Votes drawn from known accuracies: the estimates come near them, and posteriors beat single labellers."""
    rng = np.random.default_rng(7)
    n, accuracy = 20_000, np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.65, 0.8])
    truth = rng.random(n) < 0.8
    right = rng.random((n, 9)) < accuracy
    vote = np.where(right, truth[:, None], ~truth[:, None]).astype(int) * 2 - 1
    vote[rng.random((n, 9)) < 0.3] = 0
    codes, count = np.unique([weak_labels.pattern(v) for v in vote], return_counts=True)
    good, found = weak_labels.fit_labellers(codes, count.astype(float))
    assert np.abs(found - accuracy).max() < 0.05
    lookup = dict(zip(codes.tolist(), good, strict=True))
    guess = np.array([lookup[weak_labels.pattern(v)] for v in vote]) > 0.5
    assert (guess == truth).mean() > 0.95


def test_weak_labels_table(table):
    got = weak_labels.classify(table).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs(table))
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)


def test_weak_labels_like_plain(spark, docs):
    """The votes counted, EM, the sample, the scorer's steps and the scores, each as a plain loop."""
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    order = {r["doc_id"]: (r["h"], r["t"]) for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h", "xxhash64(text) as t").collect()}
    want = brute.weak_labels(rows, order, weak_labels)
    got = {r["doc_id"]: r for r in weak_labels.classify(docs).collect()}
    for i, (good, bad, posterior, score) in want.items():
        assert (got[i]["votes_good"], got[i]["votes_bad"]) == (good, bad)
        assert abs(got[i]["posterior"] - posterior) < 1e-6 and abs(got[i]["score"] - score) < 1e-4 and got[i]["kept"] == (got[i]["score"] >= 0.5)


def test_weak_labels_against_labels(spark):
    """No label was used: clean documents stay, and most junk goes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = weak_labels.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    clean, junk = [k for k, q in got if q == 1], [k for k, q in got if q == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) / len(junk) < 0.15


# --- 8 ---


def test_exact_dedup(table):
    rows = [(i, t) for i, t in pairs(table)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = exact_dedup.dedup(table).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_first(table)
    assert kept.count() == len(groups) and kept.columns == table.columns


def test_exact_dedup_resumes(spark, tmp_path):
    """A second run continues from the state: only new files of the log are read."""
    folder = f"file://{tmp_path}/state"
    rows = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    exact_dedup.dedup(rows, folder)
    got = exact_dedup.dedup(spark.createDataFrame([(3, "a  b"), (7, "d"), (8, "c")], "doc_id bigint, text string"), folder).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(3, 3, 2, True), (7, 7, 1, True), (8, 6, 2, False)]


def test_exact_dedup_compares_with_earlier_calls(spark, tmp_path, monkeypatch):
    """A digest that collides with that of a text of an earlier call: the bytes of that text are fetched and compared."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 8, "0")))
    folder = f"file://{tmp_path}/state"
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    exact_dedup.dedup(table([(1, "aa"), (2, "ccc")]), folder)
    got = exact_dedup.dedup(table([(3, "bb"), (4, "aa"), (None, "ccc"), (5, "bb"), (5, "bb")]), folder).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter([(3, 3, 3, True), (4, 1, 2, False), (None, 2, 2, False), (5, 3, 3, False), (5, 3, 3, False)])


def test_exact_dedup_spreads_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPREAD", 3)
    rows = [(i, "same  text" if i % 2 else f"own {i}") for i in range(60)]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["kept"] for r in got) == 31 and all(r["group_size"] == (30 if r["doc_id"] % 2 else 1) for r in got)


def test_exact_dedup_checks_bytes(spark, monkeypatch):
    """With a digest that collides, texts still decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 8, "0")))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc"), (5, "ccc"), (6, "bb")]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False), (6, 2, 2, False)]


# --- 9 ---


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "u", None), (6, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (None, "u", big), (9, "u", ""), (6, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as size", "'z' as payload", "2 as sha1")
    path = f"file://{tmp_path}/archive"
    got = warc_archive.archived(pages, path).collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter((i, len((h or "").encode()), digest(h), "revisit" if h == big and i != 6 else "response", 6 if h == big and i != 6 else None) for i, _, h in rows)
    assert Counter(map(tuple, got)) == want
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {r["page_id"]: bytes(r["record"]) for r in warc_archive.records(spark, path).collect()}
    for i, _, h in rows:
        record = records[i]
        head, block = record.split(b"\r\n\r\n", 1)
        size = int(brute.re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and block[size:] == b"\r\n\r\n" and len(block) == size + 4
        body = block[:size].split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if h == big and i != 6 else (h or "").encode())


def test_warc_spreads_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "SPREAD", 3)
    rows = [(i, "u", "same" if i % 3 else None) for i in range(40)]
    got = warc_archive.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, 4 if i % 3 else 0) for i in range(40)]


def test_warc_of_no_pages(spark):
    assert warc_archive.archived(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_warc_refuses_other_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc_archive.write(spark.createDataFrame([(1, "u", "a" * 2000)], "page_id bigint, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "sha1", "size", "encode('b', 'UTF-8') as payload")
    stored.write.parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        warc_archive.index(spark, path).collect()


# --- 10 ---


def test_pieces(table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for i, t in pairs(table):
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, piece_tokens.round_trip(table, PIECES, 1).collect())) == want


@pytest.fixture(scope="module")
def vocabulary_pieces():
    return piece_tokens.Pieces(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeionrst hTE\n\t.,1é▁ß日😀\x00")), max_size=70))
def test_agenda_like_library(vocabulary_pieces, text):
    p = vocabulary_pieces
    want = p.library.encode(text)
    own = p.encode([text])[0]
    assert [i for c in own for i in c.ids] == want
    assert b"".join(c.text for c in own)[1:].decode() == p.library.decode(want)
    if text:
        assert list(p.merge_heap(piece_tokens.SPACE + text.replace(" ", piece_tokens.SPACE))) == want


def test_pieces_of_long_segments(vocabulary_pieces):
    """Segments that can't be cut at spaces: long runs of one letter, of one word, of random letters, and other scripts."""
    p, rng = vocabulary_pieces, np.random.default_rng(4)
    for text in ("a" * 5000, "the" * 2000, "".join(rng.choice(list("abcdefghij"), 3000)), "\u65e5\u672c\u8a9e" * 500, "".join(map(chr, rng.integers(32, 0x2FFF, 3000)))):
        assert [i for c in p.encode([text])[0] for i in c.ids] == p.library.encode(text)
        assert list(p.merge_heap(piece_tokens.SPACE + text.replace(" ", piece_tokens.SPACE))) == p.library.encode(text)


# --- all ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12), st.integers(1, 30))
def test_word_hashes(texts, block):
    """A word has one hash wherever it stands, in one block or many; words that differ have others."""
    before = shared.BLOCK
    shared.BLOCK = block
    try:
        got = shared.word_hashes(texts)
    finally:
        shared.BLOCK = before
    known: dict = {}
    for text, hashes in zip(texts, got, strict=True):
        assert len(hashes) == len(text.split())
        for word, h in zip(text.split(), hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_bloom_filter(spark):
    rows = spark.range(2000).selectExpr("xxhash64(id) as h")
    bits = shared.bloom(rows, 2000)
    keys = np.array([r["h"] for r in rows.collect()], np.int64)
    assert shared.may_hold(bits, keys).all() and shared.may_hold(bits, keys + 1).mean() < 0.05


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_hashing_takes_little_memory():
    """A worker keeps what it took at most, and six of them share an executor."""
    import tracemalloc

    from palimpsest.llm import jaccard_join, shared

    text = b" ".join(b"w%d" % (i * 7919 % 50_000) for i in range(400_000))
    whole = np.concatenate([shared.word_hashes([w])[0] for w in text[:50_000].rsplit(b" ", 1)[0].split()])
    tracemalloc.start()
    found = shared.word_hashes([text, text[: 1 << 19]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[0][: len(whole)] == whole).all() and len(found[0]) == 400_000
    assert most < 40 << 20 and jaccard_join.HELD * 8 * 4 < 10 << 20


@pytest.mark.parametrize("words", [False, True])
def test_suffixes_take_little_memory(words):
    """So that the workers of an executor, which keep what they took at most, leave room for its JVM."""
    import tracemalloc

    text = b" ".join(b"w%d" % (i * 7919 % 50_000) for i in range(400_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([text.decode(), text[: 1 << 19].decode()])], names=["k1", "k2", "text"])
    shape = suffix_dedup.Shape(51 if words else 400, words)
    tracemalloc.start()
    found = sum(len(core) for *_, core in suffix_dedup._anchored(iter([batch]), shape))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 1000 and most < 48 << 20


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_workers_give_memory_back():
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    kept = []

    def run(batches):
        taken = []
        for batch in batches:
            for _ in range(100_000):  # blocks that the C library keeps
                taken.append(bytes(1 << 10))
            kept.append(bytes(1 << 10))  # the last block stays, and with it all below
            taken.clear()
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(run(iter([batch]))) == [batch]
    before = held()
    assert list(shared.lean(run)(iter([batch]))) == [batch]
    assert before - held() > 50 << 10
