from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def hostile_rows() -> list[tuple]:
    """Nulls in every column, empty and white texts, ties, repeated rows, long texts, near copies, other scripts."""
    words = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i * 7919 % 30011}" for i in range(30_000))
    rows = [
        (1, words),
        (2, words + " end"),
        (3, words.replace("w30", "changed")),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, "one"),
        (8, "One"),
        (9, "one two"),
        (10, long),
        (11, long),
        (12, words.upper()),
        (13, "la  la\nla\tla la la la la la la la la la la la"),
        (14, "日本語 テキスト ñandú ﬁ ① 😀 é <|endoftext|> \x00\x1c\x85　 ▁x"),
        (15, "12 34 !? ###"),
        (16, words.replace(" ", " ", 1)),
        (17, "a" * 3000),
        (18, "b" + "a" * 1200),
        (19, "l'état c'est moi, don't you'll  we're"),
        (20, "line\nline\n\nline\n"),
    ]
    return [(i, t, None if i % 3 else "en", None, None) for i, t in rows]


@pytest.fixture(scope="session")
def hostile(spark, tmp_path_factory):
    """The hostile rows as a table read from files, with one row repeated, one without a doc_id and clashing extra columns."""
    rows = [*hostile_rows(), hostile_rows()[0], (None, "no id here at all", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("hostile"))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as key", "'q' as n", "array(1) as repeats", "1 as k1", "true as kept", "'z' as digest", "2 as score", "3 as length", "1 as `a.b`", "'g' as _gone", "named_struct('file_path', 'here', 'row_index', 1) as _metadata", "'f' as place", "5 as _extra3")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
