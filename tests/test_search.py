import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions import parse, scores
from trackloom.functions import text as T
from trackloom.operators import bm25, candidates, lsh, prefilter, validate, vectors
from trackloom.plans.search import Engine, composed_query
from trackloom.session import read_table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_blend():
    assert config.W_COSINE * 0.6447 + config.W_BM25 * 0.6430 + config.W_POPULARITY * 0.78 + config.W_BONUS == pytest.approx(0.7078, abs=5e-5)


PARSES = [
    ("upbeat pop songs", ["pop"], [], [("valence", ">", 0.6)]), ("something sad and nostalgic", [], ["sad", "nostalgic"], [("valence", "<", 0.4)]),
    ("rap and r&b", ["r&b", "hip-hop"], [], []), ("hard rock anthems", ["rock"], [], []),
    ("happy but also melancholic", [], ["happy", "melancholic"], [("valence", ">", 0.6), ("valence", "<", 0.4)]), ("asdkfj qwerty", [], [], []),
    ("chill acoustic folk", ["folk"], ["chill"], [("acousticness", ">", 0.6), ("energy", "<", 0.4)]),
    ("fast energetic electronic", ["electronic"], ["energetic"], [("tempo", ">", 120.0), ("energy", ">", 0.7)]),
]


def test_parser(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSES)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", parse.genres_in(t).alias("g"), parse.moods_in(t).alias("m"), parse.merged_filters(parse.filters_in(t)).alias("f")).orderBy("i").collect()
    for (text, genres, moods, filters), r in zip(PARSES, rows):
        q = parse.parse_query(text)
        assert (q.genres, q.moods, q.filters) == (genres, moods, filters)
        assert (r["g"], r["m"], [tuple(x) for x in r["f"]]) == (genres, moods, filters)
    assert parse.merged([("a", ">", 1), ("b", "<", 2), ("a", ">", 3), ("b", "<", 1)]) == [("a", ">", 3), ("b", "<", 1)]
    with pytest.raises(ValueError):
        parse.checked("title; DROP", ">")
    with pytest.raises(ValueError):
        parse.checked("energy", ">=")


def test_text(spark):
    assert one(spark, T.tokens(F.lit("Hip-Hop & café 99 don't"))) == ["hip", "hop", "caf", "don't"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.derive_tags(F.lit(0.6), F.lit(0.39))) == "chill,dreamy" and one(spark, T.derive_tags(F.lit(None), F.lit(float("nan")))) == ""
    assert one(spark, T.expand_queries(F.lit("Blue Moon"), F.lit("Bo"), F.lit("sad"))) == ["Blue Moon", "Bo", "melancholic,emotional,sad", "Bo sad", "Blue"]
    assert one(spark, T.expand_queries(F.lit("  "), F.lit(None).cast("string"))) == []
    assert one(spark, T.error_category(F.lit("tempo is not numeric: 'x'"))) == "tempo" and one(spark, T.error_category(F.lit("valence=1.8 out"))) == "valence"


def test_scores(spark):
    def duration(r):
        return one(spark, scores.duration_alignment(F.lit(r * 1000.0), F.lit(1000.0)))

    assert [duration(r) for r in (0.5, 2.0, 1.0)] == [1.0] * 3 and duration(2.01) == pytest.approx(0.49) and duration(0.49) == pytest.approx(0.99) and duration(9) == 0
    assert one(spark, scores.duration_alignment(F.lit(5.0), F.lit(0.0))) == 1.0 and one(spark, scores.popularity_alignment(F.lit(5), F.lit(None).cast("double"))) == 0.5
    empty = F.array().cast("array<string>")
    assert [one(spark, scores.artist_freshness(a, F.array(F.lit("x")))) for a in (F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")), empty)] == [0.3, 1.0, 0.5]
    assert one(spark, scores.clipped_cosine([F.lit(0.0)], [F.lit(1.0)])) == 0.5 and one(spark, scores.clipped_cosine([F.lit(-1.0)], [F.lit(1.0)])) == 0.0


def test_genres(spark):
    assert [one(spark, candidates.genre_of_keyword(F.lit(k))) for k in ("soul", "techno", "nothing")] == ["indie", "electronic", "indie"]
    assert one(spark, candidates.genre_of_artist(F.lit(["big house music", " RAP "]))) == "hip-hop"
    assert one(spark, candidates.genre_of_artist(F.lit(["xx", "deep house music"]))) == "electronic" and one(spark, candidates.genre_of_artist(F.lit(["zzz"]))) is None


def test_ladder(spark):
    def tracks(n):
        return spark.createDataFrame([(str(i), "pop" if i < n + 5 else "x", 0.9 if i < n else 0.1) for i in range(60)], "id string, genre string, valence double")

    q = parse.ParsedQuery("", ["pop"], [], [("valence", ">", 0.6)])
    assert [prefilter.relaxed(tracks(n), q).level for n in (30, 29, 25, 24)] == ["full", "genre_only", "genre_only", "unrestricted"]
    assert prefilter.relaxed(tracks(24), parse.ParsedQuery("", [], [], [("valence", ">", 0.6)])).level == "genre_only"
    full, relaxed = prefilter.relaxed(tracks(30), q), prefilter.relaxed(tracks(29), q)
    assert {r[0] for r in full.rows.select(prefilter.satisfied(full)).collect()} == {1} == {r[0] for r in relaxed.rows.select(prefilter.satisfied(relaxed)).collect()}


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(i, ["a"] if i < 9 else []) for i in range(10)], "id int, tokens array<string>")
    raw = {r["id"]: r["bm25"] for r in bm25.bm25_scores(docs, "id", "tokens", "a a zzz").collect()}
    idf = 1 + math.log((10 - 9 + 0.5) / (9 + 0.5))
    assert idf < 0 and raw[9] == 0 and raw[0] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / 0.9)))
    norm = {r["id"]: r["bm25"] for r in bm25.max_normalized(bm25.bm25_scores(docs, "id", "tokens", "a", docs.filter("id < 9"))).collect()}
    assert all(v == pytest.approx(1.0) for v in norm.values()) and len(norm) == 9
    zero = {r["bm25"] for r in bm25.max_normalized(bm25.bm25_scores(docs, "id", "tokens", "zzz")).collect()}
    assert zero == {0.0}
    assert bm25.corpus_stats(bm25.document_lengths(docs.limit(0), "id", "tokens")).first()["avgdl"] == 1.0


def test_vectors(spark):
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    v = one(spark, vectors.audio_vector7(lambda d: F.lit(None).cast("double")))
    raw = np.array([0.5] * 5 + [0.0025, 1.0])
    assert v == pytest.approx(list(raw / np.linalg.norm(raw)))
    assert vectors.query_audio_vector([("energy", ">", 1), ("energy", "<", 0), ("nope", ">", 1)])[1] == -1.0
    df = spark.createDataFrame([("x",), ("calm music that",)], "t string")
    embedder = vectors.HashEmbedder(16)
    for r in df.select("t", embedder.column(F.col("t")).alias("v")).collect():
        assert r["v"] == pytest.approx(list(embedder.vector(r["t"])))
    equal = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, s double")
    assert {r["s"] for r in vectors.minmax_applied(equal, ["s"]).collect()} == {0.5}
    assert vectors.minmax_stats(equal.limit(0), ["s"]).first()["min"] is None


def probing(table_of, keys, bits, radius, enough):
    """The rule of probing, stated step by step."""
    found = set()
    for t in range(len(keys)):
        for r in range(radius + 1):
            for rr, m in lsh.probe_masks(bits, radius):
                if rr == r:
                    found |= table_of.get((t, keys[t] ^ m), set())
            if enough is not None and len(found) >= enough:
                return found
    return found


@pytest.mark.parametrize("enough", [1, 20, 60, 10_000, None])
def test_early_stop(spark, enough):
    rng = np.random.default_rng(1)
    planes = lsh.normal_planes(8, 3, 6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 8)))]
    df = spark.createDataFrame([*rows, (999, None)], "id int, v array<double>")
    index = lsh.hashed(df, "id", "v", planes)
    asked = index.filter("id < 5").withColumnRenamed("id", "query")
    got = {}
    for r in lsh.candidates(index, asked, "query", "id", enough, 6, 2).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    keys = {i: [int(((np.array(v) @ planes[t].T > 0) * (1 << np.arange(6))).sum()) for t in range(3)] for i, v in rows}
    table = {}
    for i, ks in keys.items():
        for t, k in enumerate(ks):
            table.setdefault((t, k), set()).add(i)
    for q in range(5):
        assert got[q] == probing(table, keys[q], 6, 2, enough)


def test_engine(spark, small, tmp_path):
    cat = validate.catalogue(read_table(spark, small, "tracks"))
    engine = Engine.build(cat)
    rows = {r["id"]: r for r in engine.tracks.join(engine.vectors(), "id").select("id", "embedding", "valence", "popularity", "genre").collect()}
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-6) for r in rows.values())
    ids = sorted(rows)[:3]
    got = engine.recommend([*ids, ids[0]], "happy", 5).collect()
    pool = [r for r in rows.values() if r["valence"] > 0.6]
    taste = np.mean([rows[i]["embedding"] for i in ids], axis=0)
    taste /= np.linalg.norm(taste)
    assert len(pool) >= 30 and not set(ids) & {r["track_id"] for r in got} and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    for r in got:
        track = rows[r["track_id"]]
        assert r["filter_level"] == "full" and r["score"] == pytest.approx(0.85 * np.dot(track["embedding"], taste) + 0.15 * track["popularity"] / 100 + 0.05)
    exact = Engine(engine.tracks, engine.stats)
    best = exact.recommend(ids, None, 4).collect()
    everyone = sorted((-round(float(np.dot(r["embedding"], taste)), 12), i) for i, r in rows.items() if i not in ids)[:4]
    assert {r["track_id"] for r in best} == {i for _, i in everyone}
    for bad in ([], ["nope"], [*sorted(rows)[:6]]):
        with pytest.raises(ValueError):
            engine.recommend(bad)
    with pytest.raises(ValueError):
        engine.recommend(ids, "grumpy")
    with pytest.raises(ValueError):
        engine.search("pop", 0)
    assert engine.search("asdkfj qwerty", 3).count() == 3 and engine.search("pop", 5, rank_all=True).count() == 5
    engine.save(str(tmp_path))
    again = Engine.load(spark, str(tmp_path), cat)
    assert again.search("chill acoustic folk", 5).collect() == engine.search("chill acoustic folk", 5).collect()
    with pytest.raises(RuntimeError):
        again.check_ids(cat.limit(5))
    stored = spark.read.parquet(f"{tmp_path}/vectors")
    with pytest.raises(RuntimeError):
        Engine.check_norms(stored.withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    plan = bm25.bm25_stored(again.postings, again.frequencies, again.corpus, cat.select("id", F.lit(3).alias("dl")), "id", "acoustic folk")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(id), In(term" in plan or "In(term, [acoustic,folk])" in plan
    exact.save(str(tmp_path / "plain"))  # an engine without a hash index
    plainly = Engine.load(spark, str(tmp_path / "plain"), cat)
    assert plainly.index is None and plainly.search("sad jazz", 4).collect() == exact.search("sad jazz", 4).collect()


def test_another_embedder(spark, small):
    """An embedder needs column and vector only; the fast paths of the built-in one agree with it."""
    built_in = vectors.HashEmbedder(16)

    class Plain:
        dims = 16
        column, vector = built_in.column, built_in.vector

    cat = validate.catalogue(read_table(spark, small, "tracks")).limit(200)
    a, b = Engine.build(cat, Plain()), Engine.build(cat, built_in)
    assert sorted(map(tuple, a.index.collect())) == sorted(map(tuple, b.index.collect()))
    x, y = ({r["id"]: r["embedding"] for r in e.vectors().collect()} for e in (a, b))
    assert all(np.allclose(x[i], y[i]) for i in x)
    got = [[(r["track_id"], round(r["score"], 6)) for r in e.search("chill folk", 5).collect()] for e in (a, b)]
    assert got[0] == got[1]


def test_zero_vectors():
    assert np.linalg.norm(composed_query(np.zeros(384), [0.0] * 9)) == 0


def test_validation_rules(spark):
    from trackloom.schema import RECORD_FIELDS

    good = dict(zip(RECORD_FIELDS, ["a", "T", "A", "g", "", "0", "1", "0.5", "300", "-60", "0", "0", "0", "0", "1", "11", "0", "7", "100"]))
    rows = [good, good | {"title": " ", "valence": "1.8", "mode": "7"}, good | {"id": "b", "title": ""}, good | {"id": " b "}, good | {"id": ""}, good | {"id": ""}, good | {"id": "c", "energy": None, "key": "nan", "tempo": "it's"}]
    df = spark.createDataFrame([(i, *[r[f] for f in RECORD_FIELDS]) for i, r in enumerate(rows)], ["row_num", *RECORD_FIELDS])
    checked = validate.validated(df)
    errors = {r["row_num"]: r["errors"] for r in checked.select("row_num", "errors").collect()}
    assert errors[0] == [] and errors[1] == ["title is missing/empty", "valence=1.8 out of range [0,1]", "mode=7 must be 0 or 1", "duplicate id: a"]
    assert errors[2] == ["title is missing/empty"] and errors[3] == ["duplicate id: b"] and errors[4] == errors[5] == ["id is missing/empty"]
    assert errors[6] == ["energy is not numeric: None", 'tempo is not numeric: "it\'s"', "key is not numeric: 'nan'"]
    assert validate.load_summary(checked).first().asDict() == {"total": 7, "loaded": 1, "rejected": 6}
    assert validate.load_summary(validate.validated(df.limit(0))).first()["total"] == 0


def test_hot_and_blank_ids(spark):
    """An id that a third of all rows share, blank ids, and extra columns."""
    rows = [(i, "hot" if i % 3 == 0 else " " if i % 3 == 1 else f"u{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_num long, id string, _Salt int")
    got = {r["row_num"]: r["duplicate"] for r in validate.duplicate_flags(df, "row_num").collect()}
    assert len(got) == 3000 and {r for r, d in got.items() if d} == {i for i in range(3, 3000, 3)}


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from trackloom.session import ensure_checkpoint_dir

    named = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077", setCheckpointDir=named.append)
    settings = {}
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)
    settings["spark.checkpoint.dir"] = "s3://bucket/x"
    ensure_checkpoint_dir(session)
    assert named == ["s3://bucket/x"]
