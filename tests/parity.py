"""Rows of a query against rows of its SQL, as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

DATA = "/root/testdata"


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(DATA, sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def rows_of(table: pa.Table) -> tuple[list[str], Counter]:
    names = sorted(table.column_names)

    def plain(x: object) -> object:
        if isinstance(x, float):
            return round(x, 9)
        return tuple(x) if isinstance(x, list) else x

    return names, Counter(tuple(plain(v) for v in row) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def difference(spark, query, sql: str, sf: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if the two agree."""
    ours, mine = rows_of(query(spark, f"{DATA}/{sf}").toArrow())
    theirs, other = rows_of(con.execute(sql).to_arrow_table())
    if ours != theirs:
        return f"columns {ours} and {theirs}"
    if mine == other:
        return ""
    return f"{sum(mine.values())} and {sum(other.values())} rows; only ours {list((mine - other).items())[:3]}; only theirs {list((other - mine).items())[:3]}"
