"""A corpus pipeline of five operators: quality rules, exact dedup, Jaccard join, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text fails the first stage's rules, so it goes there; the later stages take such rows too, as their
docstrings say. Nulls in other columns are passed on. Rows that repeat a doc_id, and rows without one, are rows of their own. Texts may
be of any length. Of ties, the smallest doc_id stays. An empty table goes through all stages as an empty table. Further columns of
documents, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, jaccard_join, packing, quality_repeats, suffix_dedup
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.shared import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep: null, empty and very short texts go. Every row has its own verdict."""
    return quality_repeats.clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts. Null counts as empty, so of all null and empty texts one row would stay; of rows that
    repeat the smallest doc_id, one stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that Jaccard links connect: 0.8 or more of shingles of five words. Texts without words, and rows
    without doc_id, are linked with nothing and stay."""
    return jaccard_join.keep_one(docs, pct=80, k=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages: over 50 words, or 400 bytes (scripts without spaces). No row goes; a text may become
    empty, a null text becomes empty or stays null."""
    return suffix_dedup.clean(docs, words=51)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4,096 tokens; a null or empty text is one piece of the end id."""
    return packing.sequences(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: Tokenising and packing have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
