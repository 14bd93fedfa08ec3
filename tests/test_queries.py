"""Every registered query with an SQL counterpart gives its rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tideline import queries, queries_analyst, queries_checks, queries_counts, queries_omop, queries_values  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "-"
        return f"{float(x):.6g}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows(spark, con, name):
    assert canonical(queries.QUERIES[name](spark, DIR).toPandas()) == canonical(con.execute(queries.SQL[name]).df())
