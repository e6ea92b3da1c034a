"""The operators' queries against their DuckDB SQL."""

import duckdb
import pytest

from tidemill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(got.columns) == names
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
