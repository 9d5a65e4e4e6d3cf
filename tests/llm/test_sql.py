"""The numbered queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from veridoc.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in got.fetchall()))) == sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
