"""Hybrid search and recommendation over a catalogue, and the engine that ties both to stored artefacts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions import text as T
from trackloom.functions.parse import ParsedQuery, mood_filters, parse_query
from trackloom.operators import bm25, candidates, lsh, prefilter, vectors
from trackloom.session import checkpointed
from trackloom.vocab import MOODS

SHOWN = ["title", "artist", "genre", "mood_tags"]


def features_built(catalogue: DataFrame) -> DataFrame:
    """catalogue with tokens (of the lexical document) and described (the text that is embedded)."""
    return catalogue.withColumns({
        "tokens": T.lexical_tokens(F.col("title"), F.col("artist"), F.col("genre"), F.col("mood_tags")),
        "described": T.semantic_text(F.col("genre"), F.col("mood_tags")),
    })


@dataclass
class Engine:
    """Search and recommend over built features. Results are DataFrames.

    tracks: the catalogue with tokens and descriptions. stats: per feature its least and greatest value. Vectors are not kept: the
    cosine with a query and the buckets of the hash index come straight from descriptions and features; a saved engine holds them.
    postings, frequencies: of a saved engine, the inverted index and each term's number of documents.
    reference_probing: stop probing at MIN_CANDIDATES proposals, as the reference does, and lose nearest tracks by it.
    """

    tracks: DataFrame
    stats: dict[str, tuple[float, float]]
    index: DataFrame | None = None
    planes: np.ndarray | None = None
    embedder: object = field(default_factory=vectors.HashEmbedder)
    reference_probing: bool = False
    corpus: tuple[int, float] | None = None
    postings: DataFrame | None = None
    frequencies: DataFrame | None = None

    @staticmethod
    def build(catalogue: DataFrame, embedder=None, indexed: bool = True) -> Engine:
        """Features, written once to the checkpoint folder, and the hash index unless indexed is False (then search is exact)."""
        embedder = embedder or vectors.HashEmbedder()
        tracks = checkpointed(features_built(catalogue))
        row = tracks.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in config.AUDIO_FEATURES for n, f in (("min", F.min), ("max", F.max))]).first()
        engine = Engine(tracks, {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in config.AUDIO_FEATURES}, embedder=embedder)
        if indexed:
            engine.planes = lsh.normal_planes(getattr(embedder, "dims", config.TEXT_DIMS) + len(config.AUDIO_FEATURES))
            engine.index = checkpointed(tracks.select("id", F.posexplode(engine._bucket_keys()).alias("table_idx", "bucket")))
        return engine

    def _audio(self) -> list[Column]:
        """The min-max scaled features."""
        return [vectors.minmax_scaled(F.col(c).cast("double"), F.lit(low), F.lit(high)) for c, (low, high) in self.stats.items()]

    def _bucket_keys(self) -> Column:
        if hasattr(self.embedder, "bucket_keys"):
            return self.embedder.bucket_keys(F.col("described"), self._audio(), self.planes)
        return lsh.bucket_keys(self._composed(), self.planes)

    def _composed(self) -> Column:
        if hasattr(self.embedder, "composed"):
            return self.embedder.composed(F.col("described"), self._audio())
        return vectors.compose(self.embedder.column(F.col("described")), F.array(*self._audio())).cast("array<float>")

    def _cosine(self, query: np.ndarray) -> Column:
        """Of a track with a unit query."""
        if hasattr(self.embedder, "similarity"):
            return self.embedder.similarity(F.col("described"), self._audio(), query)
        return vectors.dot_with(self._composed(), list(query))

    def vectors(self, rows: DataFrame | None = None) -> DataFrame:
        """(id, embedding array<float>), unit length, of all tracks or of the given ones."""
        return (self.tracks if rows is None else rows).select("id", self._composed().alias("embedding"))

    def save(self, folder: str) -> None:
        """Writes the artefacts as Parquet tables: tracks, vectors, stats, the inverted index sorted by term, and the hash index if
        there is one. Raises if a vector is not of unit length."""
        spark = self.tracks.sparkSession
        self.tracks.write.mode("overwrite").parquet(f"{folder}/tracks")
        self.vectors().write.mode("overwrite").parquet(f"{folder}/vectors")
        self.check_norms(spark.read.parquet(f"{folder}/vectors"))
        spark.createDataFrame([(c, *b) for c, b in self.stats.items()], "feature string, min double, max double").write.mode("overwrite").parquet(f"{folder}/stats")
        index = bm25.postings(self.tracks, "id", "tokens")
        index.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        bm25.document_frequency(spark.read.parquet(f"{folder}/postings")).sort("term").write.mode("overwrite").parquet(f"{folder}/frequencies")
        bm25.corpus_stats(bm25.document_lengths(self.tracks, "id", "tokens")).withColumn("indexed", F.lit(self.index is not None)).write.mode("overwrite").parquet(f"{folder}/corpus")
        if self.index is not None:
            self.index.write.mode("overwrite").parquet(f"{folder}/buckets")
            rows = [(t, b, [float(x) for x in p]) for t, bits in enumerate(self.planes) for b, p in enumerate(bits)]
            spark.createDataFrame(rows, "table_idx int, plane_idx int, plane array<double>").write.mode("overwrite").parquet(f"{folder}/planes")

    @staticmethod
    def load(spark: SparkSession, folder: str, catalogue: DataFrame | None = None, embedder=None) -> Engine:
        """Reads saved artefacts, with a hash index or without. With a catalogue: refuses artefacts whose ids differ from it."""
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        corpus = read("corpus").first()
        stats = {r["feature"]: (r["min"], r["max"]) for r in read("stats").collect()}  # one row a feature
        engine = Engine(read("tracks"), {c: stats[c] for c in config.AUDIO_FEATURES}, embedder=embedder or vectors.HashEmbedder(),
                        corpus=(corpus["n"], corpus["avgdl"]), postings=read("postings"), frequencies=read("frequencies"))
        if corpus["indexed"]:
            rows = read("planes").orderBy("table_idx", "plane_idx").collect()  # tables x bits rows
            engine.planes = np.array([r["plane"] for r in rows]).reshape(1 + rows[-1]["table_idx"], 1 + rows[-1]["plane_idx"], -1)
            engine.index = read("buckets")
        if catalogue is not None:
            engine.check_ids(catalogue)
        return engine

    @staticmethod
    def check_norms(stored: DataFrame) -> None:
        """Raises unless all vectors are of unit length (or zero: nothing is known of the track)."""
        norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
        if not stored.filter((F.abs(norm - 1) > 1e-3) & (norm != 0)).isEmpty():
            raise RuntimeError("vectors are not of unit length")

    def check_ids(self, catalogue: DataFrame) -> None:
        """Raises unless the artefacts hold exactly the catalogue's ids."""
        own, theirs = self.tracks.select("id"), catalogue.select("id")
        if not own.exceptAll(theirs).isEmpty() or not theirs.exceptAll(own).isEmpty():
            raise RuntimeError("artefacts and catalogue hold different ids: build the artefacts again")

    def _scoped(self, allowed: DataFrame, query: np.ndarray, k: int) -> DataFrame:
        """Allowed rows that the index proposes; all allowed rows if those are too few or might lack one of the k nearest.

        A vector as near as the k-th proposal, or nearer, is missed by the probes with a probability that follows from the angle.
        """
        if self.index is None:
            return allowed
        needed = max(config.MIN_CANDIDATES, k * config.OVERSAMPLE)
        spark = self.tracks.sparkSession
        asked = lsh.hashed(spark.createDataFrame([(0, [float(x) for x in query])], "query int, v array<double>"), "query", "v", self.planes)
        enough = config.MIN_CANDIDATES if self.reference_probing else None
        proposed = checkpointed(lsh.candidates(self.index, asked, "query", "id", enough, self.planes.shape[1], few=True).select("id"))  # ids, read twice
        scoped = allowed.join(proposed, "id", "left_semi")
        if self.reference_probing:
            return scoped if scoped.limit(needed).count() >= needed else allowed
        nearest = scoped.select(self._cosine(query).alias("cosine")).orderBy(F.desc("cosine")).limit(needed).collect()
        safe = len(nearest) >= needed and lsh.miss_probability(nearest[k - 1]["cosine"], *self.planes.shape[:2]) <= config.MISS_PROBABILITY
        return scoped if safe else allowed

    def search(self, text: str, k: int = 10, rank_all: bool = False) -> DataFrame:
        """The k best tracks for a free text.

        The k most similar vectors are taken first and then ranked by the blended score; with rank_all all candidates are
        ranked by it. Ties: blended score, then cosine, then id. k must be at least 1; no match gives an empty result.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        query = parse_query(text)
        pre = prefilter.relaxed(self.tracks, query)
        vector = composed_query(self.embedder.vector(text), vectors.query_audio_vector(query.filters))
        scoped = self._scoped(pre.rows, vector, k)
        lexical = bm25.max_normalized(self._lexical(text, scoped))
        scored = scoped.withColumn("cosine", self._cosine(vector))
        if not rank_all:
            scored = scored.orderBy(F.desc("cosine"), "id").limit(k)
        joined = scored.join(lexical, "id")
        return _ranked(joined, pre, k, {"cosine": config.W_COSINE, "bm25": config.W_BM25, "popularity_norm": config.W_POPULARITY})

    def _lexical(self, text: str, scoped: DataFrame) -> DataFrame:
        """(id, bm25) of the scoped rows: from the stored postings of the query's terms, else from the token arrays."""
        if self.postings is None:
            return bm25.bm25_scores(self.tracks, "id", "tokens", text, scoped)
        hits = bm25.bm25_stored(self.postings, self.frequencies, self.corpus, scoped.select("id", F.size("tokens").alias("dl")), "id", text)
        return scoped.select("id").join(hits, "id", "left").select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))

    def recommend(self, favourite_ids: list[str], mood: str | None = None, k: int = 10) -> DataFrame:
        """The k tracks most like one to five favourites, favourites left out, a mood's filters applied.

        Raises for no or too many ids, for unknown ids and for k below 1.
        """
        ids = list(dict.fromkeys(favourite_ids))
        if not 1 <= len(ids) <= config.MAX_FAVORITES or k < 1:
            raise ValueError(f"give 1 to {config.MAX_FAVORITES} favourite ids and k of at least 1")
        if mood is not None and mood not in MOODS:
            raise ValueError(f"unknown mood: {mood}")
        own = self.vectors(self.tracks.filter(F.col("id").isin(ids))).collect()  # five rows at most
        if unknown := sorted(set(ids) - {r["id"] for r in own}):
            raise ValueError(f"unknown ids: {unknown}")
        pre = prefilter.relaxed(self.tracks, ParsedQuery("", [], [mood] if mood else [], mood_filters([mood] if mood else [])))
        taste = np.mean([r["embedding"] for r in own], axis=0)
        taste = taste / (np.linalg.norm(taste) or 1)
        scoped = self._scoped(pre.rows.filter(~F.col("id").isin(ids)), taste, k)
        scored = scoped.withColumn("cosine", self._cosine(taste)).orderBy(F.desc("cosine"), "id").limit(k)
        return _ranked(scored, pre, k, {"cosine": config.RECOMMEND_W_COSINE, "popularity_norm": config.RECOMMEND_W_POPULARITY})


def composed_query(text: np.ndarray, audio: list[float]) -> np.ndarray:
    """A query's vector, as vectors.compose makes a track's."""
    a = np.array(audio)
    v = np.concatenate([text * config.TEXT_WEIGHT, a / (np.linalg.norm(a) or 1) * config.AUDIO_WEIGHT])
    return v / (np.linalg.norm(v) or 1)


def _ranked(scored: DataFrame, pre: prefilter.Prefiltered, k: int, weights: dict[str, float]) -> DataFrame:
    scored = scored.withColumns({"popularity_norm": F.col("popularity") / 100.0, "relaxation_bonus": config.W_BONUS * prefilter.satisfied(pre)})
    score = sum((F.col(c) * w for c, w in weights.items()), F.col("relaxation_bonus"))
    order = [F.desc("score"), F.desc("cosine"), F.asc("id")]
    best = scored.withColumn("score", score).orderBy(*order).limit(k)
    ranks = F.row_number().over(Window.orderBy(*order))  # k rows
    return best.withColumn("rank", ranks).select(
        "rank", F.col("id").alias("track_id"), *SHOWN, "score", *weights, "relaxation_bonus", F.lit(pre.level).alias("filter_level")
    )


def live_candidates(favs: DataFrame, catalogue: DataFrame, request: str = "request_id", per_query: int = 20, limit: int | Column = 30, mood: str | None = None) -> DataFrame:
    """(request, id, pos, further columns of favs): what searching a catalogue for each favourite's title and artist words proposes.

    A search text proposes the tracks in whose title or artist it stands as one or more whole words, without regard to letter
    case and to further blanks, up to per_query by id. limit: candidates of a request, a number or a Column over the further
    columns, which are the same in all rows of a request. mood: a further column whose keywords are searched for too.
    """
    kept = [c for c in favs.columns if c not in (request, "pos", "id")]
    known = favs.join(catalogue.select("id", "title", "artist"), "id")
    said = F.col(mood) if mood else None
    texts = known.select(request, *kept, F.col("pos").alias("_fav"), F.posexplode(T.expand_queries(F.col("title"), F.col("artist"), said)).alias("_q", "_text"))
    texts = texts.withColumn("_text", T.folded(F.col("_text")))
    keys = catalogue.select("id", F.explode(F.array_distinct(F.concat(T.word_runs(F.col("title")), T.word_runs(F.col("artist"))))).alias("_text"))
    keys = keys.join(texts.select("_text").distinct(), "_text", "left_semi")
    numbered = keys.withColumn("_item", F.row_number().over(Window.partitionBy("_text").orderBy("id"))).filter(F.col("_item") <= per_query)
    hits = texts.join(numbered, "_text").withColumn("pos", F.struct("_fav", "_q", "_item"))
    together = hits.select(request, "id", "pos", *kept).repartition(request)  # else pooled shuffles by request and id, then by request
    return candidates.pooled(together, request, "id", "pos", limit)


def recommend_live(requests: DataFrame, catalogue: DataFrame, features: DataFrame | None = None, k: int = 10, mood_searches: bool = False) -> DataFrame:
    """(request_id, rank, track_id, title, artist, popularity, mood_tags, score): for every request at once.

    A request's top_k says how many it gets; k stands in for a missing one. Candidates from searches for its favourites (three
    times as many, before favourites are removed), then reranked by five signals. Ties keep the order in which candidates were
    found. features: external features by id, of which an id's first row by value counts; a candidate without any has score 0.5,
    a favourite the defaults. None: those of the catalogue. mood_tags come from valence and energy.
    mood_searches: the keywords of a request's mood are searched for too; the reference gathers without them. A mood that is
    unknown or null has none.
    """
    names = [*config.SIMILARITY_FEATURES]
    columns = ["id", "title", "artist", "popularity", "duration_ms"]
    if features is None:
        known = catalogue.select(*columns, *names, F.lit(True).alias("_featured"))
    else:
        one = candidates.with_features(features.filter(F.col("id").isNotNull()).select("id").distinct(), features)
        number = {f: F.nanvl(F.col(f"feature_{f}").cast("double"), F.lit(None).cast("double")) for f in names}
        own = one.select("id", *[F.coalesce(number[f], F.lit(config.DEFAULT_FEATURE)).alias(f) for f in names], F.greatest(*[v.isNotNull() for v in number.values()]).alias("_featured"))
        known = catalogue.select(*columns).join(own, "id", "left").fillna(config.DEFAULT_FEATURE, names).fillna(False, ["_featured"])
    known = checkpointed(known)  # read four times
    wanted = F.coalesce("top_k", F.lit(k)) if "top_k" in requests.columns else F.lit(k)
    said = F.col("mood") if mood_searches and "mood" in requests.columns else F.lit(None).cast("string")
    favs = candidates.favourites(requests.withColumns({"_k": wanted, "_mood": said}), keep=("_k", "_mood"))
    pool = live_candidates(favs, known, limit=3 * F.col("_k"), mood="_mood").withColumnRenamed("pos", "_pos")
    profile = candidates.favourite_profile(favs, known)
    rows = pool.join(known, "id").join(profile, "request_id").filter(~F.array_contains("fav_ids", F.col("id")))
    artists = F.when(F.col("artist") != "", F.array(F.lower("artist"))).otherwise(F.array().cast("array<string>"))
    scored = rows.withColumn("score", candidates.rerank_score(artists, F.col("_featured")))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.round("score", 9).desc(), "_pos"))
    ranked = scored.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_k"))
    tags = T.derive_tags(F.col("valence"), F.col("energy")).alias("mood_tags")
    return ranked.select("request_id", F.col("_rank").alias("rank"), F.col("id").alias("track_id"), "title", "artist", "popularity", tags, "score")
