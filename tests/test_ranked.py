"""All rows are ranked, over many ranges, with ties."""

from __future__ import annotations

from palimpsest.operators.matching import ranked
from palimpsest.plans.relational import R


def test_ranked(spark):
    rows = [((i * 37) % 11, i) for i in range(1300)]
    for some in (rows, rows[:1], []):
        got = ranked(spark.createDataFrame(some, "k bigint, id bigint").repartition(7), "k", "id").collect()
        assert sorted((r["place"], r["k"], r["id"]) for r in got) == [(n + 1, *x) for n, x in enumerate(sorted(some))]


def test_whole_sort_keeps_all_rows(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/events.parquet").count()
    got = {r["id"]: r["place"] for r in R.queries["t01_sort_by_height"](spark, folder).collect()}
    assert n > 500 and sorted(got.values()) == list(range(1, n + 1))
    assert all(got[r["id"]] == r["place"] for r in R.queries["t01_sort_by_height"](spark, folder).collect())
