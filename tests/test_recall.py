"""What the hashing index loses of search and recommend, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions.parse import parse_query
from trackloom.operators import lsh, validate, vectors
from trackloom.plans.search import Engine, composed_query
from trackloom.session import read_table


@pytest.fixture(scope="module")
def engine(spark, small):
    """Eight tracks near each one, so that the first probes find enough rows but not the nearest."""
    cat = validate.catalogue(read_table(spark, small, "tracks")).crossJoin(spark.range(8).withColumnRenamed("id", "copy"))
    moved = {f: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f) + (F.xxhash64("id", "copy", F.lit(f)) % 1000) / 5000.0)) for f in ("danceability", "energy", "valence", "acousticness", "liveness")}
    return Engine.build(cat.withColumns(moved).withColumn("id", F.concat_ws("-", "id", "copy")).drop("copy"))


def nearest(rows, query, k):
    return {i for _, i in sorted((-float(np.dot(v, query)), i) for i, v in rows)[:k]}


def test_recall(engine):
    vecs = {r["id"]: np.array(r["embedding"]) for r in engine.vectors().collect()}
    ids, shares = sorted(vecs), []
    for favs in (ids[7:10], [ids[100], ids[3000], ids[5000]], [ids[2500]]):
        taste = np.mean([vecs[i] for i in favs], axis=0)
        want = nearest([(i, v) for i, v in vecs.items() if i not in favs], taste, 10)
        shares.append(len(want & {r["track_id"] for r in engine.recommend(favs).collect()}) / 10)
    assert np.mean(shares) >= 0.9
    shares = []
    for text in ("asdkfj qwerty", "energetic"):
        query = composed_query(engine.embedder.vector(text), vectors.query_audio_vector(parse_query(text).filters))
        allowed = engine.tracks.filter("energy > 0.7") if text == "energetic" else engine.tracks
        want = nearest([(r["id"], r["embedding"]) for r in engine.vectors(allowed).collect()], query, 10)
        shares.append(len(want & {r["track_id"] for r in engine.search(text).collect()}) / 10)
    assert np.mean(shares) >= 0.9


def test_miss_probability():
    rng, (bits, tables) = np.random.default_rng(3), (6, 3)
    missed = 0
    for _ in range(2000):
        planes, (a, b) = lsh.normal_planes(4, tables, bits, rng.integers(1 << 30)), (np.array([1.0, 0, 0, 0]), np.array([0.5, 0.75**0.5, 0, 0]))
        missed += all(((planes[t] @ a > 0) != (planes[t] @ b > 0)).sum() > 1 for t in range(tables))
    assert missed / 2000 == pytest.approx(lsh.miss_probability(0.5, tables, bits, 1), abs=0.04)
    assert lsh.miss_probability(1.0) == 0 and lsh.miss_probability(0.0) > config.MISS_PROBABILITY
