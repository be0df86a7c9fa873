"""Candidate pools, favourites, and reranking for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import DEFAULT_DURATION, DEFAULT_FEATURE, DEFAULT_POPULARITY, RERANK_WEIGHTS, SIMILARITY_FEATURES
from trackloom.functions import scores
from trackloom.vocab import ARTIST_GENRES, DEFAULT_GENRE, GENRES, KEYWORD_GENRES


def favourites(requests: DataFrame, request: str = "request_id", ids: str = "favorite_track_ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(request, pos, id): each favourite once, in order of first mention. Null and empty ids are skipped. keep: columns to carry."""
    once = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))
    return requests.select(request, *keep, F.posexplode(once).alias("pos", "id"))


def unknown_favourites(favs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Favourites that the catalogue lacks."""
    return favs.join(catalogue.select("id"), "id", "left_anti")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key are dropped. Map-side minimum, no sort of a hot key."""
    rest = [c for c in df.columns if c not in (key, *order)]
    first = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(key, "_f.*").select(*df.columns)


def pooled(found: DataFrame, group: str, key: str, pos: str, limit: int | Column) -> DataFrame:
    """Union of search results per group: position of a key's first sight, values of its last sight, the first `limit` keys.

    limit: a number, or a Column over found's further columns.
    """
    rest = [c for c in found.columns if c not in (group, key, pos)]
    merged = found.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(group, key).agg(
        F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias("_last") if rest else F.lit(None).alias("_last")
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(pos, key))
    cut = merged.withColumn("_r", rank).select(group, key, pos, "_r", *([F.col("_last.*")] if rest else [])).filter(F.col("_r") <= limit)
    return cut.drop("_r")


def with_features(candidates: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """candidates, each with the first of its feature rows (least by value) or nulls."""
    names = [c for c in features.columns if c != key]
    one = features.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("_f")).select(key, "_f.*")
    return candidates.join(one.select(key, *[F.col(c).alias(f"feature_{c}") for c in names]), key, "left")


def favourite_profile(favs: DataFrame, catalogue: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request the means of its favourites' features, popularity and duration (placeholders where a value or the track is
    unknown), their artists in lower case and their ids. Requests have few favourites each."""
    known = favs.join(catalogue.select("id", "artist", "popularity", "duration_ms", *SIMILARITY_FEATURES), "id", "left")
    means = [F.avg(F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.lit(DEFAULT_FEATURE))).alias(f"fav_{f}") for f in SIMILARITY_FEATURES]
    return known.groupBy(request).agg(
        *means,
        F.avg(F.coalesce("popularity", F.lit(DEFAULT_POPULARITY))).alias("fav_popularity"),
        F.avg(F.coalesce("duration_ms", F.lit(DEFAULT_DURATION))).alias("fav_duration"),
        F.array_sort(F.collect_set(F.when(F.col("artist") != "", F.lower("artist")))).alias("fav_artists"),
        F.collect_set("id").alias("fav_ids"),
    )


def component_scores(names: Column) -> dict[str, Column]:
    """The five scores of a candidate joined with its request's favourite_profile. names: its artists, lower case."""
    return {
        "audio": scores.clipped_cosine([F.col(f) for f in SIMILARITY_FEATURES], [F.col(f"fav_{f}") for f in SIMILARITY_FEATURES]),
        "popularity": scores.popularity_alignment(F.col("popularity"), F.col("fav_popularity")),
        "acoustic": scores.acoustic_alignment(F.col("acousticness"), F.col("fav_acousticness")),
        "duration": scores.duration_alignment(F.col("duration_ms"), F.col("fav_duration")),
        "artist": scores.artist_freshness(names, F.col("fav_artists")),
    }


def rerank_score(names: Column, has_features: Column | None = None) -> Column:
    """Weighted sum of the component scores; 0.5 for candidates without features."""
    parts = component_scores(names)
    score = sum((parts[p] * w for p, w in RERANK_WEIGHTS.items()), F.lit(0.0))
    return score if has_features is None else F.when(has_features, score).otherwise(0.5)


def genre_of_keyword(keyword: Column) -> Column:
    """Genre of a crawl keyword; the default where the keyword, or its genre, is unknown."""
    table = F.create_map(*[F.lit(x) for k, g in KEYWORD_GENRES.items() if g in GENRES for x in (k, g)])
    return F.coalesce(F.try_element_at(table, keyword), F.lit(DEFAULT_GENRE))


def genre_of_artist(genres: Column) -> Column:
    """Genre of an artist's list of genres: the first that is known, else the first that contains a known one; else null."""
    table = F.create_map(*[F.lit(x) for kv in ARTIST_GENRES.items() for x in kv])
    exact = F.filter(F.transform(genres, lambda g: F.try_element_at(table, F.lower(F.trim(g)))), lambda g: g.isNotNull())
    inside = lambda g: F.array_compact(F.array(*[F.when(F.contains(F.lower(g), F.lit(k)), F.lit(v)) for k, v in ARTIST_GENRES.items()]))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(F.flatten(F.transform(F.array_compact(genres), inside)), F.lit(0)))
