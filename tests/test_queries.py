"""Every core query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from trackloom.plans.queries import core_queries, core_sql


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def compare(spark, folder, plan, sql):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    df = plan(spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    want = sorted(tuple(map(norm, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_equals_sql(spark, small, name):
    compare(spark, small, core_queries()[name], core_sql()[name])


@pytest.mark.parametrize("name", ["recommend_live", "recommend_local", "hybrid_search_indexed", "embed_text", "p1_profile", "p6_loaded", "p6_rejected"])
def test_runs(spark, small, name):
    assert core_queries()[name](spark, small).count() > 0
