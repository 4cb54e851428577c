"""The operators' queries that have SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tracequarry.llm import entries


def plain(rows, order):
    value = lambda v: ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entries.ORACLE))
def test_query_as_sql(spark, sf, name):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame, other = entries.QUERIES[name](spark, sf), con.sql(entries.ORACLE[name])
    assert sorted(frame.columns) == sorted(other.columns)
    names = sorted(frame.columns)
    got = plain([tuple(r) for r in frame.collect()], [frame.columns.index(c) for c in names])
    assert got and got == plain(other.fetchall(), [other.columns.index(c) for c in names])
