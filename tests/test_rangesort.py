import random

from pyspark.sql import functions as F

from trackloom.operators.rangesort import range_positions, range_running_totals


def test_positions_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}", rng.choice([None, 1, 5])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k string, w int")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["id"]: r["position"] for r in range_positions(df, [F.col("k"), F.col("id")]).collect()}
    assert [got[r[0]] for r in order] == list(range(5000))
    before = {r["id"]: r["before"] for r in range_running_totals(df, [F.col("k"), F.col("id")], "w").collect()}
    total = 0
    for i, _, w in order:
        assert before[i] == total
        total += w or 0


def test_empty(spark):
    df = spark.createDataFrame([], "id long, w int")
    assert range_positions(df, [F.col("id")]).count() == 0 and range_running_totals(df, [F.col("id")], "w").count() == 0
