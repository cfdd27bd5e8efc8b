"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from palimpsest.llm import quality_repeats
from palimpsest.llm.queries import vocabulary


def plain(rows: list[tuple[int, str]]) -> dict[int, str]:
    """doc_id and text before packing."""
    limits = quality_repeats.Limits()
    kept = []
    for i, t in rows:
        n_words, chars, *_, failed = brute.quality(t)
        longest = brute.longest_repeat(brute.WORD.findall(t or ""))
        if not failed and 100 * brute.covered_chars(t) <= limits.covered_chars_pct * chars and longest <= limits.longest_repeat:
            kept.append((i, t))
    found = brute.dedup(kept)
    kept = [(i, t) for i, t in kept if found[i][2]]
    linked = brute.jaccard_components(kept, 80, 5)
    kept = [(i, t) for i, t in kept if linked[i][1] == i]
    return brute.cleaned(kept, 400, 51)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    stage_docs = docs
    from palimpsest.llm.shared import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = written(stage(spark, stage_docs, folder), name.replace(" ", "_"))
        assert stage_docs.columns == docs.columns
    last = {r["doc_id"]: r["text"] for r in stage_docs.collect()}
    assert last == want
    got = corpus_pipeline.run(spark, folder).collect()
    ids = dict(zip(last, brute.token_ids(list(last.values()), vocabulary("word_bpe_49k.json")), strict=True))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert all(brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_stages_on_hostile_rows(spark, hostile, empty):
    from palimpsest.llm.shared import written

    for table in (hostile, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, ""), name.replace(" ", "_"))
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_passages_of_51_words(spark):
    """51 shared words under 400 bytes go, 50 stay; so does a shared string of 400 bytes in one word."""
    word = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    short, less, one = word("p", 51), word("q", 50), "z" * 100 + "".join(chr(0x4E00 + i) for i in range(200))
    assert len(short.encode()) < 400
    texts = [f"a1 {short} a2", f"b1\n{short} b2 {less} b3", f"c1 {less} c2", f"d1 {one} d2", f"e1 {one} e2"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert {i: got[i].split() for i in (0, 1, 2)} == {0: ["a1", "a2"], 1: ["b1", "b2", *less.split(), "b3"], 2: texts[2].split()}
    assert all(len(got[i]) < 10 and got[i].startswith("de"[i - 3]) and got[i].endswith("2") for i in (3, 4))


def test_passages_like_plain(spark, docs, texts):
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want, of_bytes = brute.without_repeated_words(texts, 51), brute.repeats(texts)
    by_words = [i for i, _ in texts if not of_bytes[i][1]]
    assert all(got[i] == want[i] for i in by_words)
    assert any(want[i] != (t or "") for i, t in texts if i in by_words)
    assert all(len(got[i].encode()) <= min(n - removed, len(want[i].encode())) for i, (n, removed, _, _) in of_bytes.items())


def test_near_copies_of_five_words(spark):
    """Four changed words: under 0.9 on three words, over 0.8 on five. With more changes it is another document."""
    words = [f"w{i}" for i in range(200)]
    changed = lambda at: " ".join("other" + w if i in at else w for i, w in enumerate(words))
    texts = [changed([]), changed([40, 80, 120, 160]), changed([20, 50, 80, 110, 140])]
    three, five = ([brute.shingles(t, k) for t in texts] for k in (3, 5))
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(three[0], three[1]) < 0.9 and share(five[0], five[1]) >= 0.8 > share(five[0], five[2])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {0, 2}


def test_near_copies_like_plain(spark, docs, texts):
    linked = brute.jaccard_components(texts, 80, 5)
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {i for i, (_, root) in linked.items() if root == i or not brute.shingles(dict(texts)[i], 5)}
