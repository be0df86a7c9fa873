import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import clusters as C
from trackloom.session import read_table


def test_groups_and_noise(spark):
    rng = np.random.default_rng(6)
    centres = rng.permutation(np.array([[x, y] for x in (0.1, 0.5, 0.9) for y in (0.1, 0.5, 0.9)]))
    near = lambda c, n: c + 0.1 * np.sqrt(rng.random(n))[:, None] * np.array([[np.cos(a), np.sin(a)] for a in rng.random(n) * 7])
    points = np.vstack([near(c, 400 if i == 0 else 40) for i, c in enumerate(centres)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(5000 + i, 0.3, 0.3) for i in range(5)] + [(6000, None, 0.1), (6001, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "k long, a double, b double").withColumn("Cluster", F.lit(9))
    vectors = C.vectorised(df, "k", {"a": 1.0, "b": 1.0}, F.lit(True))
    found = C.fit(vectors, "k", 27, radius=0.15)
    assigned = C.assign(vectors, "k", found, 0.15)
    got = {r["k"]: r["cluster"] for r in assigned.collect()}
    start = 0
    for i in range(9):
        size = 400 if i == 0 else 40
        assert len({got[k] for k in range(start, start + size)}) == 1
        start += size
    assert len({got[k] for k in range(start)}) == 9 and 6000 not in got and 6001 not in got
    typical = C.describe(assigned, "k", 3).collect()
    assert max(r["size"] for r in typical) == 400 and {r["member_rank"] for r in typical} == {1, 2, 3}


def test_edges(spark):
    empty = spark.createDataFrame([], "k long, x array<double>")
    assert len(C.fit(empty, "k", 3)) == 0 and C.assign(empty, "k", C.fit(empty, "k", 3)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "k long, x array<double>")
    assert C.fit(same, "k", 4).tolist() == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        C.hashed_slots([f"f{i}" for i in range(10)], 4)


def test_anchors(spark, small):
    tracks, anchors = read_table(spark, small, "tracks"), read_table(spark, small, "anchor_tracks")
    got = {r["row_num"]: r["anchor_id"] for r in C.anchored_groups(tracks, anchors).collect()}
    assert C.anchored_groups(tracks, anchors.limit(0)).count() == 0
    rows = [r for r in tracks.select("row_num", *C.TRACK_WEIGHTS).collect() if all(r[f] is not None and r[f] == r[f] for f in C.TRACK_WEIGHTS)]
    rows = [r for r in rows if 0 <= r["danceability"] <= 1 and 0 <= r["energy"] <= 1 and 0 < r["tempo"] <= 300 and -60 <= r["loudness"] <= 5]
    x = np.array([[r[f] * w for f, w in C.TRACK_WEIGHTS.items()] for r in rows])
    want = {}
    for a in anchors.collect():
        c = np.array([a[f] * w for f, w in C.TRACK_WEIGHTS.items()])
        for _ in range(50):
            c = x[((x - c) ** 2).sum(1) <= 0.15**2].mean(0)
        want |= {rows[i]["row_num"]: a["anchor_id"] for i in np.flatnonzero(((x - c) ** 2).sum(1) <= 0.15**2)}
    assert got == want


def test_anchors_beyond_the_broadcast(spark, small, monkeypatch):
    tracks, anchors = read_table(spark, small, "tracks"), read_table(spark, small, "anchor_tracks")
    nulls = anchors.limit(1).selectExpr("anchor_id + 1000 AS anchor_id", "CAST(NULL AS double) AS danceability", "energy", "tempo", "loudness")
    want = sorted(map(tuple, C.anchored_groups(tracks, anchors.unionByName(nulls)).collect()))
    monkeypatch.setattr(C, "BROADCAST_ANCHORS", 0)
    assert sorted(map(tuple, C.anchored_groups(tracks, anchors.unionByName(nulls)).collect())) == want


def test_a_fit_that_does_not_rest_is_an_error(spark, monkeypatch):
    rows = [(i, [float(i % 40), float(i // 40)]) for i in range(400)]
    points = spark.createDataFrame(rows, "k long, x array<double>")
    monkeypatch.setattr(C, "MOST_ROUNDS", 0)
    with pytest.raises(RuntimeError):
        C.fit(points, "k", 3, radius=0.5)


def test_small_groups_among_many_rows(spark):
    """More rows than any sample of 50,000 holds: groups of a ten-thousandth of them are found whole, and noise is no group."""
    rng = np.random.default_rng(4)
    disc = lambda c, n: c + 0.1 * np.sqrt(rng.random(n))[:, None] * np.array([[np.cos(a), np.sin(a)] for a in rng.random(n) * 7])
    places = np.array([[x, y] for x in (0.0, 1.0, 2.0, 3.0) for y in (0.0, 1.0, 2.0)])
    sizes = [20_000, 15_000, 12_000, 10_000] + [6] * 8
    noise = rng.random((60, 2)) * [3.8, 2.8] - 0.4
    noise = noise[((noise[:, None] - places) ** 2).sum(2).min(1) > 0.2**2]
    x = np.vstack([disc(c, n) for c, n in zip(places, sizes)] + [noise])
    points = spark.createDataFrame(pa.table({"k": np.arange(len(x)), "x": pa.array(list(x))})).repartition(4)
    found = C.fit(points, "k", 36, radius=0.15, gap=(0.12, 0.18))
    got = {r["k"]: r["cluster"] for r in C.assign(points, "k", found, 0.15).collect()}
    ends = np.cumsum([0, *sizes])
    clusters = [{got.get(k) for k in range(a, b)} for a, b in zip(ends[:-1], ends[1:])]
    assert all(len(c) == 1 and None not in c for c in clusters) and len(set.union(*clusters)) == len(sizes)


def test_every_pass_counts_every_point(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.random((9000, 3)), np.full((600, 3), 0.5)])
    centres = rng.random((70, 3))
    blocks = C.packed(spark.createDataFrame(pa.table({"k": np.arange(len(x)), "x": pa.array(list(x))})).repartition(3), "k", 11)
    squared = ((x[:, None] - centres) ** 2).sum(2)
    for radius, member in ((None, squared.argmin(1)[:, None] == np.arange(70)), (0.15, squared <= 0.15**2), (0.7, squared <= 0.7**2)):
        new, counts, _ = C._means(blocks, centres, radius)
        assert counts.tolist() == member.sum(0).tolist()
        assert np.allclose(new, np.where(counts[:, None] > 0, member.T @ x / np.maximum(counts, 1)[:, None], centres))


def test_noise_is_no_group(spark):
    rng = np.random.default_rng(7)
    near = np.array([0.5, 0.5, 0.8, -0.4]) + rng.normal(size=(200, 4)) * 0.02
    noise = rng.random((30_000, 4)) * [1, 1, 1, -1] + [0, 0, 0.3, 0]
    noise = noise[((noise - [0.5, 0.5, 0.8, -0.4]) ** 2).sum(1) > 0.2**2]
    x = np.vstack([near, noise])
    tracks = spark.createDataFrame(pa.table({"row_num": np.arange(len(x)), "danceability": x[:, 0], "energy": x[:, 1], "tempo": x[:, 2] * 150, "loudness": x[:, 3] * 30}))
    assigned, centres = C.track_groups(tracks, 1)
    assert len(centres) == 1 and {r["row_num"] for r in assigned.collect()} == set(range(200))
    lonely = spark.createDataFrame([(1, 0.5, 0.5, 120.0, -12.0), (2, 0.9, 0.1, 60.0, -2.0)], "anchor_id long, danceability double, energy double, tempo double, loudness double")
    assert {(r["row_num"], r["anchor_id"]) for r in C.anchored_groups(tracks, lonely).collect()} == {(i, 1) for i in range(200)}
