from __future__ import annotations

import parity
import pytest

from __spark_entry__ import REGISTRIES

SF = "sf0.001"
#: Queries of expressions, joins and pipelines are compared on ten times as many rows, as some cases don't occur among fewer.
LARGER = "sf0.01"
SQL = {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
QUERIES = {name: f for r in REGISTRIES for name, f in r.queries.items()}


@pytest.fixture(scope="module")
def con():
    return {sf: parity.connection(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, con, name):
    sf = LARGER if name[0] in "pje" else SF
    assert parity.difference(spark, QUERIES[name], SQL[name], sf, con[sf]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
