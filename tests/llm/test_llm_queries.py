import math
import os

import duckdb
import pytest

from trackloom.llm.queries import llm_queries, llm_sql


def norm(value):
    return f"{value:.6g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    df, relation = llm_queries()[name](spark, small), con.sql(llm_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    want = sorted(tuple(map(norm, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["p4_neighbours", "p5_groups", "p8_shares", "p9_redacted"])
def test_runs(spark, small, name):
    assert llm_queries()[name](spark, small).count() > 0
