import random

import pytest
from pyspark.sql import functions as F

from trackloom.llm import cap


def removed(df, limit):
    return {r["k"] for r in cap.rows_over_cap(df, cap.contributor_key(F.col("name")), F.col("score"), "k", limit).collect()}


def test_cap(spark):
    rng = random.Random(5)
    spellings = ["The Band", " the  BAND ", "The Band"]
    rows = [(i, rng.choice(spellings) if rng.random() < 0.4 else rng.choice([None, " ", "A", "B", f"n{i}"]), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, name string, score int").withColumn("Position", F.lit(1))
    for limit in (0, 1, 40, 5000):
        groups = {}
        for k, name, score in rows:
            key = " ".join((name or "").replace(" ", " ").split()).lower()
            if key:
                groups.setdefault(key, []).append((-(score if score is not None else -1), k))
        assert removed(df, limit) == {k for g in groups.values() for _, k in sorted(g)[limit:]}
    assert removed(df.limit(0), 3) == set()
    assert cap.cap_share(df, cap.contributor_key(F.col("name")), F.col("score"), "k", 100).count() > 0
    with pytest.raises(ValueError):
        removed(df, -1)


def test_many_contributors_over_the_cap(spark, monkeypatch):
    """Beyond the broadcast: joined by contributor, salted; one contributor holds a third of all rows."""
    df = spark.range(3000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('n', id % 500) END AS name", "id % 7 AS score")
    want = removed(df, 2)
    monkeypatch.setattr(cap, "BROADCAST_CONTRIBUTORS", 0)
    assert removed(df, 2) == want and want
