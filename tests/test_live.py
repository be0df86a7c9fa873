"""Recommendations for many requests at once against a plain loop over the requests."""

import math

import pytest

from trackloom import config
from trackloom.operators import validate
from trackloom.plans.search import recommend_live
from trackloom.session import read_table

SIM = config.SIMILARITY_FEATURES


def texts_of(track):
    title, artist = track["title"], track["artist"]
    first = title.split()[0]
    return [title, artist, *([first] if len(first) > 3 else [])]


def folded(name):
    return f" {' '.join(name.lower().split())} "


def searched(tracks, text):
    """tracks: by id."""
    return [t for t in tracks if folded(text) in folded(t["title"]) or folded(text) in folded(t["artist"])][:20]


def score(track, favs):
    mean = {f: sum(t[f] for t in favs) / len(favs) for f in (*SIM, "popularity", "duration_ms")}
    norms = math.hypot(*[track[f] for f in SIM]) * math.hypot(*[mean[f] for f in SIM])
    audio = min(1, max(0, sum(track[f] * mean[f] for f in SIM) / norms)) if norms else 0.5
    ratio = track["duration_ms"] / mean["duration_ms"]
    duration = 1 if 0.5 <= ratio <= 2 else max(0, 1 - max(abs(ratio - 1) - 0.5, 0))
    fresh = 0.3 if track["artist"].lower() in {t["artist"].lower() for t in favs} else 1
    parts = {"audio": audio, "popularity": max(0, 1 - abs(track["popularity"] - mean["popularity"]) / 100), "acoustic": max(0, 1 - abs(track["acousticness"] - mean["acousticness"])), "duration": duration, "artist": fresh}
    return sum(parts[p] * w for p, w in config.RERANK_WEIGHTS.items())


def looped(request, tracks, k):
    by_id = {t["id"]: t for t in tracks}
    unknown = {f: config.DEFAULT_FEATURE for f in SIM} | {"popularity": config.DEFAULT_POPULARITY, "duration_ms": config.DEFAULT_DURATION, "artist": ""}
    ids = [i for i in dict.fromkeys(request["favorite_track_ids"]) if i]
    pool = {}
    for i in ids:
        for text in texts_of(by_id[i]) if i in by_id else []:
            for t in searched(tracks, text):
                pool.setdefault(t["id"], t)
    favs = [by_id.get(i, unknown) for i in ids]
    scored = [(score(t, favs), t["id"]) for t in list(pool.values())[: 3 * k] if t["id"] not in ids]
    return sorted(scored, key=lambda x: -round(x[0], 12))[:k]


def test_recommend_live_per_request(spark, small):
    cat, requests = validate.catalogue(read_table(spark, small, "tracks")), read_table(spark, small, "recommend_requests")
    tracks = sorted((r.asDict() for r in cat.collect()), key=lambda t: t["id"])
    got = {}
    for r in recommend_live(requests, cat, None).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r)
    asked = requests.collect()
    assert any(r["top_k"] > 10 for r in asked) and any(r["top_k"] < 10 for r in asked)
    for r in asked:
        want, rows = looped(r, tracks, r["top_k"]), got.get(r["request_id"], [])
        assert [x["rank"] for x in rows] == list(range(1, len(want) + 1))
        assert [x["score"] for x in rows] == pytest.approx([s for s, _ in want])
        assert {x["track_id"] for x in rows} == {i for _, i in want}
