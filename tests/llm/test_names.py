"""Columns of any name go through the operators that keep rows, and places of any name hold their tables."""

from __future__ import annotations

from urllib.parse import quote

import pytest

import corpus_pipeline
from palimpsest.llm import exact_dedup, jaccard_join, quality_repeats, suffix_dedup

WORDS = " ".join(f"w{i}" for i in range(30))
ROWS = [(1, WORDS, "x"), (2, WORDS, "y"), (3, f"{WORDS} more", "z"), (4, "other " * 3 + WORDS[::-1], None)]
KEEP = {
    "quality": quality_repeats.clean,
    "exact": exact_dedup.keep_first,
    "jaccard": jaccard_join.keep_one,
    "suffix": suffix_dedup.clean,
}


NAMES = ["a.b", "`", "_gone", "place", "_metadata", "_metadata.file_path", "_extra2", "rest", "file", "row", "k1", "digest", "component_id", "repeats", "", "TEXT", "Doc_Id"]


@pytest.mark.parametrize("keep", KEEP)
def test_any_name(spark, keep):
    """Also names that differ from needed ones in case only."""
    docs = spark.createDataFrame([(i, t, *(f"{e}{n}" for n in range(len(NAMES)))) for i, t, e in ROWS], ", ".join(["doc_id long, text string", *(f"c{n} string" for n in range(len(NAMES)))])).toDF("doc_id", "text", *NAMES)
    got = KEEP[keep](docs)
    assert got.columns == docs.columns
    extra = {tuple(r)[0]: tuple(r)[2:] for r in got.collect()}
    assert extra == {i: tuple(f"{e}{n}" for n in range(len(NAMES))) for i, _, e in ROWS if i in extra} and {1, 4} <= set(extra)


def test_stages_keep_clashing_columns(spark, tmp_path):
    """A table from files with columns that the stages themselves use, and a struct called like the hidden one."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, extra string").selectExpr("*", "'en' as lang", "'g' as _gone", "'b' as `a.b`", "named_struct('file_path', 'f', 'row_index', 7L) as _metadata")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert all(r["_gone"] == "g" and r["a.b"] == "b" and tuple(r["_metadata"]) == ("f", 7) for r in got.collect())


@pytest.mark.parametrize("folder", ["a dir%41", "a[b]{c}*? spät"])
def test_dedup_goes_on_in_folders_of_any_name(spark, tmp_path, folder):
    """The row that stays is read again from the first call's table."""
    parts = []
    for i, rows in enumerate([ROWS[:1], ROWS[1:]]):
        path = tmp_path / f"{i}{folder}"
        spark.createDataFrame(rows, "doc_id long, text string, extra string").write.parquet(f"file://{path}")
        parts.append(spark.read.parquet(exact_dedup.as_path("file://" + quote(str(path)))))
    state = f"file://{tmp_path}/state"
    assert [r["kept"] for r in exact_dedup.dedup(parts[0], state).collect()] == [True]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(parts[1], state).collect()}
    assert got == {2: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True)}
