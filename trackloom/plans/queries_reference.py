"""Queries of the search and recommendation operators, each with the SQL it is checked against (None: only SQL cannot say it)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom import config
from trackloom.functions import parse, scores
from trackloom.functions import text as T
from trackloom.functions.parse import GENRE_KEYS, ParsedQuery
from trackloom.operators import bm25, candidates, lsh, prefilter, validate, vectors
from trackloom.operators.coerce import in_range, is_blank, to_real, to_whole
from trackloom.plans import search
from trackloom.schema import ERROR_ORDER, RECORD_FIELDS, RULES
from trackloom.session import read_table
from trackloom.vocab import ADJECTIVES, ARTIST_GENRES, DEFAULT_GENRE, GENRES, KEYWORD_GENRES, MOOD_HINTS, MOOD_KEYWORDS, MOODS

REGISTRY: dict = {}
LEXICAL_QUERY = "the council and the ferry"
SEARCH_QUERY = "upbeat happy pop songs for a road trip"


def query(sql: str | None = None, name: str | None = None):
    """Registers a plan over (tables) with its SQL."""

    def register(plan):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(lambda table: read_table(spark, folder, table))

        REGISTRY[name or plan.__name__] = (run, sql)
        return plan

    return register


def registry() -> dict:
    """name -> (plan, SQL or None)."""
    return REGISTRY


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# ---- SQL that several queries share ----
_B = r"[\s\x{a0}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def _sql_blank(c: str) -> str:
    return f"coalesce({_strip(c)}, '') = ''"


def _sql_range(f: str) -> str:
    rule = RULES[f]
    return f"{f} {'>' if rule.open_low else '>='} {rule.low}" + (f" AND {f} <= {rule.high}" if rule.high is not None else "")


_NUMERIC = [f for f in RECORD_FIELDS if RULES[f].kind in ("real", "whole")]
_VALID = " AND ".join([*[f"NOT ({_sql_blank(f)})" for f in ("id", "title", "artist", "genre")], *[f"coalesce({_sql_range(f)}, false)" for f in _NUMERIC]])
_CAT = f"""numbered AS (SELECT *, nullif({_strip("id")}, '') AS sid FROM tracks),
firsts AS (SELECT sid, min(row_num) AS f FROM numbered WHERE sid IS NOT NULL GROUP BY sid),
cat AS (SELECT numbered.* EXCLUDE (mood_tags), coalesce(mood_tags, '') AS mood_tags FROM numbered LEFT JOIN firsts USING (sid)
  WHERE NOT coalesce(row_num > f, false) AND {_VALID})"""


def _sql_error(f: str) -> str:
    rule = RULES[f]
    if rule.kind == "text":
        return f"CASE WHEN {_sql_blank(f)} THEN '{f} is missing/empty' END"
    limits = {"duration_ms": " must be positive", "mode": " must be 0 or 1", "tempo": " out of range (0,300]"}
    limit = limits.get(f) or f" out of range [{rule.low:g},{rule.high:g}]"
    shown = f"CASE WHEN isnan({f}) THEN 'nan' ELSE {f}::VARCHAR END" if rule.kind == "real" else f"{f}::VARCHAR"
    return f"CASE WHEN {f} IS NULL THEN '{f} is not numeric: None' WHEN NOT ({_sql_range(f)}) THEN '{f}=' || {shown} || '{limit}' END"


_CHECKED = f"""numbered AS (SELECT *, nullif({_strip("id")}, '') AS sid FROM tracks),
firsts AS (SELECT sid, min(row_num) AS f FROM numbered WHERE sid IS NOT NULL GROUP BY sid),
checked AS (SELECT *, list_filter([{", ".join(_sql_error(f) for f in ERROR_ORDER)}, CASE WHEN row_num > f THEN 'duplicate id: ' || sid END], lambda e: e IS NOT NULL) AS errors
  FROM numbered LEFT JOIN firsts USING (sid))"""
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z'']+')"
_FAVS = """fav0 AS (SELECT request_id, unnest(favorite_track_ids) AS id, unnest(range(len(favorite_track_ids))) AS i FROM recommend_requests),
favs AS (SELECT request_id, id, (row_number() OVER (PARTITION BY request_id ORDER BY min(i)) - 1)::INT AS pos FROM fav0 WHERE id <> '' GROUP BY request_id, id)"""


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_map(table: dict, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def catalogue(t) -> DataFrame:
    return validate.catalogue(t("tracks"))


def checked_rows(t) -> DataFrame:
    return validate.validated(t("tracks").select("row_num", *[F.col(f).cast("string").alias(f) for f in RECORD_FIELDS]))


# ---- scans, validation, coercion ----
@query("SELECT count(*) AS n FROM tracks")
def count_all(t):
    return t("tracks").agg(F.count("*").alias("n"))


@query("SELECT genre, count(*) AS n FROM tracks GROUP BY genre")
def group_count(t):
    return t("tracks").groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre")


@query("SELECT id FROM tracks ORDER BY id")
def ordered_scan(t):
    return t("tracks").select("id").orderBy("id")


_ACCEPTED = ", ".join(f if RULES[f].kind in ("real", "whole") else f"coalesce({_strip(f)}, '') AS {f}" for f in RECORD_FIELDS)


@query(f"WITH {_CHECKED} SELECT row_num, {_ACCEPTED} FROM checked WHERE len(errors) = 0")
def validate_accept(t):
    return validate.accepted(checked_rows(t))


@query(f"WITH {_CHECKED} SELECT row_num, array_to_string(errors, '; ') AS errors, 19 AS fields, title AS raw_title, artist AS raw_artist, mode::VARCHAR AS raw_mode FROM checked WHERE len(errors) > 0")
def validate_reject(t):
    raw = lambda f: F.get_json_object("raw_json", f"$.{f}").alias(f"raw_{f}")
    fields = F.size(F.json_object_keys("raw_json")).alias("fields")
    return validate.rejected(checked_rows(t)).select("row_num", "errors", fields, raw("title"), raw("artist"), raw("mode"))


@query(f"WITH {_CHECKED} SELECT row_num FROM checked WHERE row_num > f")
def dup_id_reject(t):
    return validate.duplicate_flags(t("tracks"), "row_num").filter("duplicate").select("row_num")


@query(f"""WITH {_CHECKED}, e AS (SELECT unnest(errors) AS e FROM checked)
SELECT regexp_extract(e, '(?s)^(.*?)(?:=| is|:|$)', 1) AS category, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, category LIMIT 10""")
def reject_histogram(t):
    return validate.reject_histogram(checked_rows(t))


@query(f"WITH {_CHECKED} SELECT row_num, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0 ORDER BY row_num LIMIT 10")
def reject_sample(t):
    return validate.reject_sample(checked_rows(t))


@query(f"WITH {_CHECKED} SELECT count(*) AS total, count_if(len(errors) = 0) AS loaded, count_if(len(errors) > 0) AS rejected FROM checked")
def load_summary(t):
    return validate.load_summary(checked_rows(t))


_RAW_NUMBER = rf"{_B}*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?{_B}*"


def _raw_number(i: int) -> str:
    field = f"split_part(raw_line, ',', {i})"
    return f"CASE WHEN regexp_full_match({field}, '{_RAW_NUMBER}') THEN try_cast(regexp_replace({field}, '{_B}', '', 'g') AS DOUBLE) END"


@query(f"SELECT line_id, CASE WHEN lower(trim(split_part(raw_line, ',', 9))) = 'nan' THEN 'NaN'::DOUBLE ELSE {_raw_number(9)} END AS value FROM raw_tracks")
def coerce_double(t):
    return t("raw_tracks").select("line_id", to_real(F.split_part("raw_line", F.lit(","), F.lit(9))).alias("value"))


@query(f"SELECT line_id, trunc({_raw_number(15)})::BIGINT AS value FROM raw_tracks")
def coerce_int_trunc(t):
    return t("raw_tracks").select("line_id", to_whole(F.split_part("raw_line", F.lit(","), F.lit(15))).alias("value"))


@query(f"SELECT row_num FROM tracks WHERE {' OR '.join(_sql_blank(f) for f in ('id', 'title', 'artist', 'genre'))}")
def required_text(t):
    return t("tracks").filter(is_blank(F.col("id")) | is_blank(F.col("title")) | is_blank(F.col("artist")) | is_blank(F.col("genre"))).select("row_num")


@query("SELECT row_num, " + ", ".join(f"coalesce({_sql_range(f)}, false) AS {f}" for f in _NUMERIC) + " FROM tracks")
def range_checks(t):
    return t("tracks").select("row_num", *[in_range(F.col(f), RULES[f]).alias(f) for f in _NUMERIC])


def _sql_clamp(f: str) -> str:
    default, low, high = validate.CLAMPS[f]
    value = f"greatest({low}::DOUBLE, coalesce(CASE WHEN NOT isnan({f}) THEN {f} END, {default}::DOUBLE))"
    return f"least({high}::DOUBLE, {value}) AS {f}" if high is not None else f"{value} AS {f}"


@query("SELECT id, " + ", ".join(_sql_clamp(f) for f in validate.CLAMPS) + ", ((coalesce(key, 0) % 12) + 12) % 12 AS key, coalesce(mode, 1) AS mode FROM live_features")
def clamp_features(t):
    return validate.clamped_features(t("live_features")).select("id", *validate.CLAMPS, "key", "mode")


@query(f"SELECT DISTINCT genre, coalesce({_sql_map({k: g for k, g in KEYWORD_GENRES.items() if g in GENRES}, 'genre')}, '{DEFAULT_GENRE}') AS mapped FROM tracks")
def genre_map_exact(t):
    return t("tracks").select("genre").distinct().withColumn("mapped", candidates.genre_of_keyword(F.col("genre")))


def _sql_inside(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{v}'" for k, v in ARTIST_GENRES.items()) + " END"


@query(f"SELECT row_num, coalesce({_sql_map(ARTIST_GENRES, 'lower(trim(title))')}, {_sql_map(ARTIST_GENRES, 'lower(trim(genre))')}, {_sql_inside('title')}, {_sql_inside('genre')}) AS mapped FROM tracks")
def genre_map_fuzzy(t):
    return t("tracks").select("row_num", candidates.genre_of_artist(F.array("title", "genre")).alias("mapped"))


@query("SELECT row_num, coalesce(artist, 'Unknown') || ', ' || coalesce(genre, 'Unknown') AS artists FROM tracks")
def artist_join(t):
    names = F.array(F.struct(F.col("artist").alias("name")), F.struct(F.col("genre").alias("name")))
    return t("tracks").select("row_num", T.joined_artists(names).alias("artists"))


# ---- filters and the ladder ----
@query("SELECT row_num, genre FROM tracks WHERE genre IN ('pop', 'rock')")
def filter_in(t):
    return t("tracks").filter(prefilter.genre_condition(["pop", "rock"])).select("row_num", "genre")


@query("SELECT row_num FROM tracks WHERE energy > 0.7 AND valence < 0.4")
def filter_range_conj(t):
    return t("tracks").filter(prefilter.filter_condition([("energy", ">", 0.7), ("valence", "<", 0.4)])).select("row_num")


def _ladder(name: str, parsed: ParsedQuery) -> None:
    genre = f"list_contains({_sql_list(parsed.genres)}, genre)" if parsed.genres else "true"
    both = " AND ".join([genre, *[f"{f} {op} {v}" for f, op, v in parsed.filters]])
    sql = f"""WITH {_CAT}, c AS (SELECT count_if({both}) AS a, count_if({genre}) AS b FROM cat),
l AS (SELECT CASE WHEN a >= {config.MIN_POOL} THEN 'full' WHEN b >= {config.MIN_POOL} THEN 'genre_only' ELSE 'unrestricted' END AS level FROM c)
SELECT id, level FROM cat, l WHERE level = 'unrestricted' OR (level = 'genre_only' AND {genre}) OR (level = 'full' AND {both})"""

    @query(sql, name)
    def plan(t):
        found = prefilter.relaxed(catalogue(t), parsed)
        return found.rows.select("id", F.lit(found.level).alias("level"))


_ladder("ladder_full", ParsedQuery("", ["pop", "rock"], [], [("valence", ">", 0.6)]))
_ladder("ladder_genre_only", ParsedQuery("", ["pop"], [], [("valence", ">", 0.99), ("energy", "<", 0.01)]))
_ladder("ladder_unrestricted", ParsedQuery("", ["no such genre"], [], [("tempo", ">", 299.0)]))


@query(f"""WITH {_CAT}, p AS (SELECT count_if(genre = 'pop' AND valence > 0.6 AND energy > 0.5) >= {config.MIN_POOL} AS is_full FROM cat)
SELECT id, CASE WHEN is_full THEN round(0.05::DOUBLE * ((valence > 0.6)::INT + (energy > 0.5)::INT), 6) ELSE 0.05::DOUBLE END AS bonus
FROM cat, p WHERE genre = 'pop' AND (NOT is_full OR (valence > 0.6 AND energy > 0.5))""")
def relax_bonus(t):
    found = prefilter.relaxed(catalogue(t), ParsedQuery("", ["pop"], [], [("valence", ">", 0.6), ("energy", ">", 0.5)]))
    return found.rows.select("id", r6(config.W_BONUS * prefilter.satisfied(found), "bonus"))


@query(f"WITH {_CAT}, {_FAVS} SELECT id FROM cat WHERE id NOT IN (SELECT id FROM favs)")
def exclude_favorites(t):
    return catalogue(t).select("id").join(candidates.favourites(t("recommend_requests")).select("id"), "id", "left_anti")


@query(f"WITH {_CAT} SELECT id FROM cat WHERE id IN (SELECT id FROM live_features)")
def semi_scope(t):
    return catalogue(t).select("id").join(t("live_features").select("id"), "id", "left_semi")


# ---- joins and favourites ----
@query(f"WITH {_FAVS} SELECT request_id, pos, id FROM favs")
def dedupe_ordered(t):
    return candidates.favourites(t("recommend_requests"))


@query(f"WITH {_CAT}, {_FAVS} SELECT request_id, pos, id, title, artist FROM favs JOIN cat USING (id)")
def join_metadata(t):
    return candidates.favourites(t("recommend_requests")).join(catalogue(t), "id").select("request_id", "pos", "id", "title", "artist")


@query(f"WITH {_CAT}, {_FAVS} SELECT request_id, pos, id FROM favs WHERE id NOT IN (SELECT id FROM cat)")
def unknown_favorites(t):
    return candidates.unknown_favourites(candidates.favourites(t("recommend_requests")), catalogue(t)).select("request_id", "pos", "id")


@query(f"""WITH {_CAT}, {_FAVS} SELECT request_id, pos, id, coalesce(title, '') AS title, coalesce(popularity, 50) AS popularity, coalesce(duration_ms, 180000) AS duration_ms
FROM favs LEFT JOIN cat USING (id)""")
def favorites_left_join(t):
    joined = candidates.favourites(t("recommend_requests")).join(catalogue(t).select("id", "title", "popularity", "duration_ms"), "id", "left")
    return joined.select("request_id", "pos", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("popularity", F.lit(50)).alias("popularity"), F.coalesce("duration_ms", F.lit(180000)).alias("duration_ms"))


_LIVE = [*config.AUDIO_FEATURES, "key", "mode"]
_ONE_LIVE = f"""live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {", ".join(f"{c} NULLS FIRST" for c in ["danceability", "energy", "valence", "tempo", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "key", "mode"])}) AS k FROM live_features WHERE id IS NOT NULL) WHERE k = 1)"""


@query(f"WITH {_CAT}, {_ONE_LIVE} SELECT cat.id, coalesce(live.valence, 0.5::DOUBLE) AS valence, coalesce(live.energy, 0.5::DOUBLE) AS energy FROM cat LEFT JOIN live USING (id)")
def features_left_join(t):
    joined = candidates.with_features(catalogue(t).select("id"), t("live_features"))
    return joined.select("id", F.coalesce("feature_valence", F.lit(0.5)).alias("valence"), F.coalesce("feature_energy", F.lit(0.5)).alias("energy"))


_SIM = config.SIMILARITY_FEATURES
_PROFILE = f"""prof AS (SELECT request_id, {", ".join(f"avg(coalesce({f}, 0.5::DOUBLE)) AS fav_{f}" for f in _SIM)}, avg(coalesce(popularity, 50)) AS fav_popularity,
  avg(coalesce(duration_ms, 180000)) AS fav_duration, list_sort(list(DISTINCT lower(artist)) FILTER (artist <> '')) AS fav_artists FROM favs LEFT JOIN cat USING (id) GROUP BY request_id)"""


@query(f"""WITH {_CAT}, {_FAVS}, {_PROFILE} SELECT request_id, round(fav_energy, 9) AS energy, round(fav_popularity, 6) AS popularity, round(fav_duration, 3) AS duration,
coalesce(array_to_string(fav_artists, '|'), '') AS artists FROM prof""")
def favorite_profile(t):
    profile = candidates.favourite_profile(candidates.favourites(t("recommend_requests")), catalogue(t))
    return profile.select("request_id", F.round("fav_energy", 9).alias("energy"), r6(F.col("fav_popularity"), "popularity"), F.round("fav_duration", 3).alias("duration"), F.array_join("fav_artists", "|").alias("artists"))


# ---- scores ----
@query(f"WITH {_CAT} SELECT id, round(greatest(0, 1 - abs(popularity - 45.5) / 100), 6) AS score FROM cat")
def popularity_alignment(t):
    return catalogue(t).select("id", r6(scores.popularity_alignment(F.col("popularity"), F.lit(45.5)), "score"))


@query(f"WITH {_CAT} SELECT id, round(greatest(0, 1 - abs(acousticness - 0.3)), 6) AS score FROM cat")
def acoustic_alignment(t):
    return catalogue(t).select("id", r6(scores.acoustic_alignment(F.col("acousticness"), F.lit(0.3)), "score"))


def _sql_duration(mean: str) -> str:
    ratio = f"(duration_ms / {mean}::DOUBLE)"
    return f"CASE WHEN {ratio} BETWEEN 0.5 AND 2.0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - greatest(abs({ratio} - 1) - 0.5, 0)) END"


@query(f"WITH {_CAT} SELECT id, round({_sql_duration('150000')}, 6) AS score FROM cat")
def duration_alignment(t):
    return catalogue(t).select("id", r6(scores.duration_alignment(F.col("duration_ms"), F.lit(150000.0)), "score"))


@query(f"""WITH {_CAT}, f AS (SELECT list(DISTINCT lower(artist)) AS a FROM cat WHERE genre = 'jazz')
SELECT id, CASE WHEN list_has_any([lower(artist)], a) THEN 0.3::DOUBLE ELSE 1.0 END AS score FROM cat, f""")
def artist_freshness(t):
    cat = catalogue(t)
    known = cat.filter("genre = 'jazz'").select(F.lower("artist").alias("_a")).distinct().withColumn("_known", F.lit(True))
    names = T.artist_names(F.array(F.struct(F.col("artist").alias("name"))))
    joined = cat.withColumn("_a", F.lower("artist")).join(known, "_a", "left")
    return joined.select("id", scores.artist_freshness(names, F.when(F.col("_known"), F.array("_a")).otherwise(F.array().cast("array<string>"))).alias("score"))


def _sql_cosine(left: list[str], right: list[str]) -> str:
    dot = " + ".join(f"{a} * {b}" for a, b in zip(left, right))
    norm = lambda xs: "sqrt(" + " + ".join(f"{x} * {x}" for x in xs) + ")"
    return f"CASE WHEN {norm(left)} * {norm(right)} = 0 THEN 0.5 ELSE least(1, greatest(0, ({dot}) / ({norm(left)} * {norm(right)}))) END"


@query(f"WITH {_CAT} SELECT id, round({_sql_cosine(_SIM, ['0.6::DOUBLE', '0.7::DOUBLE', '0.5::DOUBLE', '0.2::DOUBLE', '0.1::DOUBLE'])}, 6) AS score FROM cat")
def audio_similarity(t):
    return catalogue(t).select("id", r6(scores.clipped_cosine([F.col(f) for f in _SIM], [F.lit(x) for x in (0.6, 0.7, 0.5, 0.2, 0.1)]), "score"))


@query(f"""WITH {_CAT}, {_FAVS}, {_PROFILE} SELECT prof.request_id, cat.id, round(
0.35 * ({_sql_cosine(_SIM, [f"fav_{f}" for f in _SIM])}) + 0.20 * greatest(0, 1 - abs(popularity - fav_popularity) / 100) + 0.15 * greatest(0, 1 - abs(acousticness - fav_acousticness))
+ 0.10 * ({_sql_duration("fav_duration")}) + 0.20 * (CASE WHEN list_contains(fav_artists, lower(artist)) THEN 0.3 ELSE 1.0 END), 6) AS score
FROM favs JOIN prof ON prof.request_id = favs.request_id + 1 JOIN cat ON cat.id = favs.id""")
def hybrid_rerank(t):
    favs, cat = candidates.favourites(t("recommend_requests")), catalogue(t)
    pairs = favs.select((F.col("request_id") + 1).alias("request_id"), "id").join(candidates.favourite_profile(favs, cat), "request_id").join(cat, "id")
    return pairs.select("request_id", "id", r6(candidates.rerank_score(F.array(F.lower("artist"))), "score"))


@query(f"""WITH {_FAVS}, g AS (SELECT coalesce(mood, 'none') AS mood, id, request_id * 10 + pos AS pos, request_id FROM favs JOIN recommend_requests USING (request_id)),
m AS (SELECT mood, id, min(pos) AS pos, arg_max(request_id, pos) AS request_id FROM g GROUP BY mood, id)
SELECT mood, id, pos, request_id FROM (SELECT *, row_number() OVER (PARTITION BY mood ORDER BY pos, id) AS k FROM m) WHERE k <= 50""")
def candidate_pool(t):
    requests = t("recommend_requests")
    found = candidates.favourites(requests).join(requests.select("request_id", F.coalesce("mood", F.lit("none")).alias("mood")), "request_id")
    found = found.select("mood", "id", (F.col("request_id") * 10 + F.col("pos")).alias("pos"), "request_id")
    return candidates.pooled(found, "mood", "id", "pos", 50)


@query("SELECT id, arg_min(title, row_num) AS title, min(row_num) AS row_num FROM (SELECT id, coalesce(title, '-') AS title, row_num FROM tracks) WHERE id <> '' GROUP BY id")
def crawl_dedupe(t):
    return candidates.first_seen(t("tracks").select("id", F.coalesce("title", F.lit("-")).alias("title"), "row_num"), "id", ["row_num"])


# ---- text ----
@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n, coalesce(array_to_string({_TOKENS.format('text')}, ' '), '') AS tokens FROM documents")
def tokenize(t):
    return t("documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


_LEXICAL = _TOKENS.format("concat_ws(' ', title, artist, genre, replace(mood_tags, '|', ' '))")


@query(f"SELECT row_num, coalesce(array_to_string({_LEXICAL}, ' '), '') AS tokens FROM tracks")
def lexical_tokens(t):
    return t("tracks").select("row_num", F.array_join(T.lexical_tokens(F.col("title"), F.col("artist"), F.col("genre"), F.col("mood_tags")), " ").alias("tokens"))


@query("""WITH m AS (SELECT row_num, trim(coalesce(genre, '')) AS g, list_filter(list_transform(string_split(coalesce(mood_tags, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS m FROM tracks)
SELECT row_num, CASE WHEN len(m) > 0 THEN g || ' music that feels ' || array_to_string(m, ', ') ELSE g || ' music' END AS described FROM m""")
def semantic_text(t):
    return t("tracks").select("row_num", T.semantic_text(F.col("genre"), F.col("mood_tags")).alias("described"))


_SAID = "concat_ws(' ', title, genre, replace(mood_tags, '|', ' '))"
_DISTINCT = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"


def _said():
    return F.concat_ws(" ", F.col("title"), F.col("genre"), F.replace(F.col("mood_tags"), F.lit("|"), F.lit(" ")))


_GENRE_HITS = ", ".join(rf"CASE WHEN regexp_matches(lower({_SAID}), '\b{k}\b') THEN '{g}' END" for k, g in GENRE_KEYS)


@query(f"WITH h AS (SELECT row_num, [{_GENRE_HITS}] AS h FROM tracks) SELECT row_num, coalesce(array_to_string({_DISTINCT.format('h')}, ','), '') AS genres FROM h")
def parse_genres(t):
    return t("tracks").select("row_num", F.array_join(parse.genres_in(_said()), ",").alias("genres"))


@query(f"SELECT row_num, coalesce(array_to_string(list_filter({_sql_list(MOODS)}, lambda m: list_contains({_TOKENS.format(_SAID)}, m)), ','), '') AS moods FROM tracks")
def parse_moods(t):
    return t("tracks").select("row_num", F.array_join(parse.moods_in(_said()), ",").alias("moods"))


_FILTER_HITS = ", ".join(
    [f"CASE WHEN list_contains(w, '{a}') THEN '{f}{op}{v}' END" for a, (f, op, v) in ADJECTIVES.items()]
    + [f"CASE WHEN list_has_any(w, {_sql_list(g)}) THEN '{f}{op}{v}' END" for g, f, op, v in MOOD_HINTS]
)
_WORDS = f"w AS (SELECT row_num, {_TOKENS.format(_SAID)} AS w FROM tracks)"


@query(f"WITH {_WORDS} SELECT row_num, coalesce(array_to_string(list_filter([{_FILTER_HITS}], lambda x: x IS NOT NULL), ';'), '') AS filters FROM w")
def parse_filters(t):
    return t("tracks").select("row_num", parse.written_filters(parse.filters_in(_said())).alias("filters"))


@query(f"WITH {_WORDS}, h AS (SELECT row_num, [{_FILTER_HITS}] AS h FROM w) SELECT row_num, coalesce(array_to_string({_DISTINCT.format('h')}, ';'), '') AS filters FROM h")
def merge_filters(t):
    return t("tracks").select("row_num", parse.written_filters(parse.merged_filters(parse.filters_in(_said()))).alias("filters"))


@query("""SELECT * FROM (VALUES ('valence>0.6', 'pop', 'happy')) v(filters, genres, moods)""")
def parse_query(t):
    parsed = parse.parse_query(SEARCH_QUERY)
    row = (";".join(f"{f}{op}{v}" for f, op, v in parsed.filters), ",".join(parsed.genres), ",".join(parsed.moods))
    return t("region").sparkSession.createDataFrame([row], "filters string, genres string, moods string")


@query("""SELECT request_id, CASE WHEN mood IN ('happy', 'uplifting', 'playful') THEN 0.8::DOUBLE WHEN mood IN ('sad', 'melancholic', 'nostalgic') THEN 0.2 END AS target_valence,
CASE WHEN mood IN ('energetic', 'aggressive', 'tense') THEN 0.85::DOUBLE WHEN mood IN ('chill', 'dreamy') THEN 0.2 END AS target_energy FROM recommend_requests""")
def mood_targets(t):
    targets = T.mood_targets(F.col("mood"))
    return t("recommend_requests").select("request_id", *[F.try_element_at(targets, F.lit(k)).alias(k) for k in ("target_valence", "target_energy")])


def _sql_tags(valence: str, energy: str) -> str:
    value = {"valence": valence, "energy": energy}
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT isnan({value[f]}) AND {value[f]} {op} {v} THEN '{','.join(m)}' END" for m, f, op, v in MOOD_HINTS) + ")"


@query(f"SELECT row_num, {_sql_tags('valence', 'energy')} AS tags FROM tracks")
def derive_tags(t):
    return t("tracks").select("row_num", T.derive_tags(F.col("valence"), F.col("energy")).alias("tags"))


@query(f"""WITH e AS (SELECT row_num, CASE WHEN trim(title) <> '' THEN title END AS title, CASE WHEN trim(artist) <> '' THEN artist END AS artist, regexp_extract(trim(title), '^(\\S+)', 1) AS w FROM tracks)
SELECT row_num, array_to_string(list_filter([title, artist, '{MOOD_KEYWORDS["chill"]}', artist || ' chill', CASE WHEN length(w) > 3 THEN w END], lambda x: x IS NOT NULL)[:5], '|') AS queries FROM e""")
def expand_queries(t):
    return t("tracks").select("row_num", F.array_join(T.expand_queries(F.col("title"), F.col("artist"), F.lit("chill")), "|").alias("queries"))


@query(f"""WITH {_CAT}, {_ONE_LIVE} SELECT cat.id AS track_id, title, artist AS artists, {_sql_tags("coalesce(live.valence, 0.5)", "coalesce(live.energy, 0.5)")} AS mood_tags
FROM cat LEFT JOIN live USING (id) WHERE contains(lower(title), 'harbor')""")
def typeahead(t):
    hits = candidates.with_features(catalogue(t).filter(F.contains(F.lower("title"), F.lit("harbor"))).select("id", "title", "artist"), t("live_features"))
    tags = T.derive_tags(F.coalesce("feature_valence", F.lit(0.5)), F.coalesce("feature_energy", F.lit(0.5)))
    return hits.select(F.col("id").alias("track_id"), "title", T.joined_artists(F.array(F.struct(F.col("artist").alias("name")))).alias("artists"), tags.alias("mood_tags"))


# ---- lexical ranking over documents ----
_DOCS = f"d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)"
_POST = f"{_DOCS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL)"


def _scores(scope: str = "") -> str:
    asked = T.tokens_of(LEXICAL_QUERY)
    terms = list(dict.fromkeys(asked))
    rows = ", ".join(f"('{x}', {asked.count(x)})" for x in terms)
    return f"""{_POST}, q(term, times) AS (VALUES {rows}), c AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT d.doc_id, coalesce(sum(times * (1 + ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(w) / avgdl)))), 0) AS bm25
  FROM d CROSS JOIN c LEFT JOIN (p JOIN q USING (term) JOIN f USING (term)) ON p.doc_id = d.doc_id {scope} GROUP BY d.doc_id)"""


def docs(t) -> DataFrame:
    return t("documents").select("doc_id", "lang", T.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {_POST} SELECT doc_id, term, tf FROM p")
def term_freq(t):
    return bm25.postings(docs(t), "doc_id", "tokens")


@query(f"WITH {_POST} SELECT term, count(*) AS df FROM p GROUP BY term")
def doc_freq(t):
    return bm25.document_frequency(bm25.postings(docs(t), "doc_id", "tokens"))


@query(f"WITH {_DOCS} SELECT count(*) AS n, round(coalesce(avg(len(w)), 1.0), 6) AS avgdl FROM d")
def doc_stats(t):
    stats = bm25.corpus_stats(bm25.document_lengths(docs(t), "doc_id", "tokens"))
    return stats.select("n", r6(F.col("avgdl"), "avgdl"))


@query(f"WITH {_scores()} SELECT doc_id, round(bm25, 6) AS bm25, (row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id))::INT AS rank FROM s ORDER BY round(bm25, 9) DESC, doc_id LIMIT 20")
def bm25_topk(t):
    return bm25.ranked(bm25.bm25_scores(docs(t), "doc_id", "tokens", LEXICAL_QUERY), "bm25", "doc_id", 20).select("doc_id", r6(F.col("bm25"), "bm25"), "rank")


@query(f"WITH {_scores()} SELECT doc_id, round(bm25, 6) AS bm25 FROM s JOIN (SELECT DISTINCT doc_id FROM p JOIN q USING (term)) USING (doc_id)")
def bm25_index(t):
    index, lengths = bm25.postings(docs(t), "doc_id", "tokens"), bm25.document_lengths(docs(t), "doc_id", "tokens")
    return bm25.bm25_from_index(index, lengths, "doc_id", LEXICAL_QUERY).select("doc_id", r6(F.col("bm25"), "bm25"))


@query(f"WITH {_scores()} SELECT doc_id, round(bm25, 6) AS bm25 FROM s JOIN documents USING (doc_id) WHERE lang = 'en'")
def bm25_candidates(t):
    d = docs(t)
    return bm25.bm25_scores(d, "doc_id", "tokens", LEXICAL_QUERY, d.filter("lang = 'en'")).select("doc_id", r6(F.col("bm25"), "bm25"))


@query(f"WITH {_scores()} SELECT doc_id, round(bm25 / (SELECT CASE WHEN max(bm25) = 0 THEN 1 ELSE max(bm25) END FROM s), 6) AS bm25 FROM s")
def bm25_norm(t):
    return bm25.max_normalized(bm25.bm25_scores(docs(t), "doc_id", "tokens", LEXICAL_QUERY)).select("doc_id", r6(F.col("bm25"), "bm25"))


# ---- vectors ----
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def embeddings(t) -> DataFrame:
    return t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _first_vector(t) -> list[float]:
    return embeddings(t).filter("vec_id = 0").first()["v"]


_TOP = f"""{_E}, q AS (SELECT v AS q FROM e WHERE vec_id = 0), c AS (SELECT vec_id, label, list_inner_product(v, q) AS cosine FROM e, q),
top AS (SELECT vec_id, cosine, (row_number() OVER (ORDER BY round(cosine, 9) DESC, vec_id))::INT AS rank FROM c)"""


@query(f"WITH {_TOP} SELECT vec_id, round(cosine, 6) AS cosine, rank FROM top WHERE rank <= 20")
def cosine_topk(t):
    scored = embeddings(t).select("vec_id", vectors.dot_with(F.col("v"), _first_vector(t)).alias("cosine"))
    return bm25.ranked(scored, "cosine", "vec_id", 20).select("vec_id", r6(F.col("cosine"), "cosine"), "rank")


@query(f"WITH {_E} SELECT vec_id, (i - 1)::INT AS pos, round(v[i] * 3 / sqrt(list_inner_product(v, v) * 9), 6) AS x FROM e, range(1, 65) r(i)")
def l2_normalize(t):
    unit = vectors.l2_normalize(F.transform("v", lambda x: x * 3))
    return embeddings(t).select("vec_id", F.posexplode(unit).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_E}, a AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS nv, sqrt(1 + label * label) AS na, label FROM e),
n AS (SELECT *, sqrt(0.36 * nv * nv + 0.16) AS n FROM a)
SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN i <= 64 THEN 0.6 * v[i] WHEN i = 65 THEN 0.4 / na ELSE 0.4 * label / na END / n, 6) AS x FROM n, range(1, 67) r(i)""")
def compose_vectors(t):
    made = embeddings(t).withColumn("c", vectors.compose(F.col("v"), F.array(F.lit(1.0), F.col("label").cast("double"))))
    return made.select("vec_id", F.posexplode("c").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', {1.0 if f == 'valence' else -1.0 if f == 'energy' else 0.0}::DOUBLE)" for f in config.AUDIO_FEATURES) + ") v(feature, value)")
def query_vector(t):
    v = vectors.query_audio_vector(parse.parse_query("upbeat but dreamy").filters)
    return t("region").sparkSession.createDataFrame(list(zip(config.AUDIO_FEATURES, v)), "feature string, value double")


@query(f"WITH {_CAT} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, min({f}) AS min, max({f}) AS max FROM cat" for f in config.AUDIO_FEATURES))
def minmax_stats(t):
    return vectors.minmax_stats(catalogue(t), config.AUDIO_FEATURES)


@query(f"WITH {_CAT} SELECT id, round((tempo - min(tempo) OVER ()) / (max(tempo) OVER () - min(tempo) OVER ()), 6) AS tempo, round((loudness - min(loudness) OVER ()) / (max(loudness) OVER () - min(loudness) OVER ()), 6) AS loudness FROM cat")
def minmax_apply(t):
    scaled = vectors.minmax_applied(catalogue(t).select("id", "tempo", "loudness"), ["tempo", "loudness"])
    return scaled.select("id", r6(F.col("tempo"), "tempo"), r6(F.col("loudness"), "loudness"))


@query(f"""WITH {_CAT}, m AS (SELECT id, popularity::DOUBLE AS p, min(popularity) OVER (PARTITION BY genre) AS lo, max(popularity) OVER (PARTITION BY genre) AS hi FROM cat)
SELECT id, round(CASE WHEN hi = lo THEN 0.5 ELSE (p - lo) / (hi - lo) END, 6) AS score FROM m""")
def normalize_score(t):
    return catalogue(t).select("id", "genre", "popularity").withColumn("score", vectors.normalized_scores("popularity", ["genre"])).select("id", r6(F.col("score"), "score"))


@query(f"""WITH {_E}, m AS (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, (i - 1)::INT AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)""")
def taste_centroid(t):
    return vectors.mean_vector(embeddings(t), "v", ["label"]).select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", r6(F.col("x"), "x"))


def _sql_v7(d: str) -> str:
    raw = f"coalesce(CASE WHEN NOT isnan({d}) THEN {d} END, 0.5::DOUBLE)"
    return {"tempo": f"least({raw} / 200, 1)", "loudness": f"least(greatest(({raw} + 60) / 60, 0), 1)"}.get(d, raw)


_V7 = f"""r AS (SELECT id, key, [{", ".join(_sql_v7(d) for d in vectors.AUDIO_DIMS)}] AS v FROM live_features),
v AS (SELECT id, key, v, sqrt(list_inner_product(v, v)) AS n FROM r), u AS (SELECT id, key, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v FROM v)"""


def live_vectors(t) -> DataFrame:
    return t("live_features").select("id", "key", vectors.audio_vector7(F.col).alias("v"))


@query(f"WITH {_V7} SELECT id, round(v[1], 6) AS a, round(v[6], 6) AS b, round(v[7], 6) AS c FROM u")
def audio_vector7(t):
    return live_vectors(t).select("id", r6(F.col("v")[0], "a"), r6(F.col("v")[5], "b"), r6(F.col("v")[6], "c"))


@query(f"""WITH {_V7}, m AS (SELECT key, i, avg(v[i]) AS x FROM u, range(1, 8) r(i) WHERE key IS NOT NULL GROUP BY ALL),
c AS (SELECT key, list(x ORDER BY i) AS c FROM m GROUP BY key), k AS (SELECT key, c, sqrt(list_inner_product(c, c)) AS n FROM c)
SELECT id, round(greatest(0, list_inner_product(v, c) / n), 6) AS score FROM u JOIN k USING (key)""")
def centroid_similarity(t):
    own = live_vectors(t).filter("key IS NOT NULL")
    centres = vectors.mean_vector(own, "v", ["key"]).withColumnRenamed("v", "c")
    return own.join(F.broadcast(centres), "key").select("id", r6(F.greatest(F.lit(0.0), vectors.dot(F.col("v"), F.col("c"))), "score"))  # twelve keys


@query(None)
def embed_text(t):
    return catalogue(t).select("id", vectors.HashEmbedder().column(T.semantic_text(F.col("genre"), F.col("mood_tags"))).alias("embedding"))


# ---- hashing ----
_PLANES = """planes AS (SELECT t, k, list_transform(range(64), lambda i: ((((t * 12 + k) * 64 + i) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE - 0.5) AS p FROM range(8) a(t), range(12) b(k)),
h AS (SELECT vec_id, t::INT AS table_idx, sum(CASE WHEN list_inner_product(v, p) > 0 THEN 1::BIGINT << k::INT ELSE 0 END)::INT AS bucket FROM e, planes GROUP BY vec_id, t)"""
_MASKS = "masks AS (SELECT m::INT AS m, bit_count(m::INT)::INT AS r FROM range(4096) x(m) WHERE bit_count(m::INT) <= 2)"
_CAND = f"""{_E}, {_PLANES}, {_MASKS}, qh AS (SELECT vec_id AS query, table_idx, bucket FROM h WHERE vec_id % 20 = 0),
pr AS (SELECT query, table_idx * 3 + r AS step, table_idx, xor(bucket, m) AS bucket FROM qh, masks),
hit AS (SELECT query, h.vec_id, min(step) AS step FROM pr JOIN h USING (table_idx, bucket) GROUP BY ALL),
cum AS (SELECT query, step, sum(count(*)) OVER (PARTITION BY query ORDER BY step) AS c FROM hit GROUP BY query, step),
stop AS (SELECT query, min(step) AS s FROM cum WHERE c >= {config.MIN_CANDIDATES} GROUP BY query),
cand AS (SELECT hit.query, vec_id, step FROM hit LEFT JOIN stop USING (query) WHERE s IS NULL OR step <= s)"""


def hashed(t) -> DataFrame:
    return lsh.hashed(embeddings(t), "vec_id", "v", lsh.portable_planes(64))


def _asked(h: DataFrame) -> DataFrame:
    """The vectors whose id is divisible by 20, against all."""
    return h.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query")


@query(f"WITH {_E}, {_PLANES} SELECT vec_id, table_idx, bucket FROM h")
def lsh_hash(t):
    return hashed(t)


@query(f"WITH {_E}, {_PLANES} SELECT table_idx, bucket, count(*) AS size FROM h GROUP BY ALL")
def lsh_buckets(t):
    return lsh.bucket_sizes(hashed(t))


@query(f"WITH {_CAND} SELECT query, step, table_idx, bucket FROM pr")
def lsh_multiprobe(t):
    return lsh.probes(_asked(hashed(t)), "query")


@query(f"WITH {_CAND} SELECT query, vec_id, step FROM cand")
def lsh_candidates(t):
    h = hashed(t)
    return lsh.candidates(h, _asked(h), "query", "vec_id")


@query(f"""WITH {_CAND}, n AS (SELECT query, count(*) AS n FROM cand JOIN e USING (vec_id) WHERE label IN (1, 2, 3) GROUP BY query)
SELECT qe.query, coalesce(n, 0) AS candidates, coalesce(n, 0) < {config.MIN_CANDIDATES} AS exact FROM (SELECT DISTINCT query FROM qh) qe LEFT JOIN n USING (query)""")
def ann_fallback(t):
    h = hashed(t)
    scoped = lsh.candidates(h, _asked(h), "query", "vec_id").join(embeddings(t).filter(F.col("label").isin(1, 2, 3)).select("vec_id"), "vec_id", "left_semi")
    counted = _asked(h).select("query").distinct().join(scoped.groupBy("query").agg(F.count("*").alias("n")), "query", "left")
    n = F.coalesce("n", F.lit(0))
    return counted.select("query", n.alias("candidates"), (n < config.MIN_CANDIDATES).alias("exact"))


_EVAL = f"""{_CAND}, ex AS (SELECT a.vec_id AS query, b.vec_id, list_inner_product(a.v, b.v) AS s FROM e a, e b WHERE a.vec_id % 20 = 0),
exact AS (SELECT query, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS k FROM ex) WHERE k <= 10),
app AS (SELECT query, vec_id FROM (SELECT ex.query, ex.vec_id, row_number() OVER (PARTITION BY ex.query ORDER BY round(s, 9) DESC, ex.vec_id) AS k FROM ex JOIN cand USING (query, vec_id)) WHERE k <= 10),
j AS (SELECT x.query, count(a.vec_id) AS shared, count(*) AS n, (SELECT count(*) FROM app WHERE app.query = x.query) AS m FROM exact x LEFT JOIN app a ON a.query = x.query AND a.vec_id = x.vec_id GROUP BY x.query),
ev AS (SELECT query, round(shared / (n + m - shared), 6) AS jaccard, (SELECT count(*) FROM cand WHERE cand.query = j.query) AS examined FROM j)"""


#: Queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384


def _met(vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, s): the k best of each query in each block of vectors; every block of queries meets every block of vectors."""
    blocks, parts = max(1, -(-vecs.count() // VECTOR_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("query", "q", F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")).withColumn("block", spread(blocks))
    right = vecs.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).withColumn("part", spread(parts))

    def matrix(column):
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            ids, names = held.column("vec_id").to_numpy(), asked.column("query").to_numpy()
            for name, row in zip(names, np.round(matrix(asked.column("q")) @ matrix(held.column("v")).T, 9)):
                near = np.flatnonzero(row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))])  # with all that tie
                near = near[np.lexsort((ids[near], -row[near]))[:k]]
                found.append((np.full(len(near), name), ids[near], row[near]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        return pa.table({"query": columns[0], "vec_id": columns[1], "s": columns[2]})

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(best, "query long, vec_id long, s double")


def evaluated(t) -> DataFrame:
    """(query, jaccard of the ten best with and without the index, candidates examined). Queries and vectors meet in blocks."""
    e, h = embeddings(t), hashed(t)
    cand = lsh.candidates(h, _asked(h), "query", "vec_id").select("query", "vec_id")
    asked = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("v").alias("q"))

    def ten(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "vec_id"))
        return df.withColumn("_k", rank).filter("_k <= 10").groupBy("query").agg(F.collect_set("vec_id").alias("ids"))

    exact = ten(_met(e, asked, 10))
    pairs = cand.join(e.select("vec_id", "v"), "vec_id").join(asked, "query")
    approximate = ten(pairs.select("query", "vec_id", F.round(vectors.dot(F.col("v"), F.col("q")), 9).alias("s"))).withColumnRenamed("ids", "found")
    examined = cand.groupBy("query").agg(F.count("*").alias("examined"))
    both = exact.join(approximate, "query", "left").join(examined, "query", "left")
    found = F.coalesce("found", F.array().cast("array<bigint>"))
    return both.select("query", r6(F.size(F.array_intersect("ids", found)) / F.size(F.array_union("ids", found)), "jaccard"), F.coalesce("examined", F.lit(0)).alias("examined"))


@query(f"WITH {_EVAL} SELECT query, jaccard FROM ev")
def jaccard_topk(t):
    return evaluated(t).select("query", "jaccard")


@query(f"WITH {_EVAL} SELECT query, jaccard, examined FROM ev")
def ann_eval(t):
    return evaluated(t)


@query(f"WITH {_EVAL} SELECT round(avg(jaccard), 6) AS mean_jaccard, round(median(jaccard), 6) AS median_jaccard, round(avg(examined), 6) AS mean_examined FROM ev")
def bench_summary(t):
    return evaluated(t).agg(r6(F.avg("jaccard"), "mean_jaccard"), r6(F.percentile("jaccard", 0.5), "median_jaccard"), r6(F.avg("examined"), "mean_examined"))


# ---- whole searches ----
def _sql_embedded() -> str:
    """CTEs: sl, the signed token counts of each track's description by slot; tv, their length; au, the unit audio vector; nn, the
    length of the composed vector."""
    dims = config.TEXT_DIMS
    aud = ", ".join(f"CASE WHEN max({f}) OVER () = min({f}) OVER () THEN 0.5 ELSE ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) END" for f in config.AUDIO_FEATURES)
    return f"""m AS (SELECT id, trim(genre) AS g, list_filter(list_transform(string_split(mood_tags, '|'), lambda x: trim(x)), lambda x: x <> '') AS m FROM cat),
st AS (SELECT id, CASE WHEN len(m) > 0 THEN g || ' music that feels ' || array_to_string(m, ', ') ELSE g || ' music' END AS s FROM m),
tk AS (SELECT id, md5(unnest({_TOKENS.format("s")})) AS d FROM st),
sl AS (SELECT id, ('0x' || d[1:7])::INT % {dims} AS slot, sum(CASE WHEN ('0x' || d[8:14])::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM tk GROUP BY ALL),
tv AS (SELECT id, sqrt(sum(w * w)) AS n FROM sl GROUP BY id),
a0 AS (SELECT id, [{aud}] AS a FROM cat), an AS (SELECT id, a, sqrt(list_inner_product(a, a)) AS n FROM a0),
au AS (SELECT id, list_transform(a, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS a, n FROM an),
nn AS (SELECT au.id, a, coalesce(tv.n, 0) AS tn, sqrt(0.36 * (coalesce(tv.n, 0) > 0)::INT + 0.16 * (au.n > 0)::INT) AS n FROM au LEFT JOIN tv USING (id)),
cs AS (SELECT nn.id, (0.6 * coalesce(any_value(d.d), 0) + 0.4 * list_inner_product(any_value(a), (SELECT audio FROM q))) / any_value(n) AS cosine
  FROM nn LEFT JOIN (SELECT id, sum(w / tn * t.x) AS d FROM sl JOIN nn USING (id) JOIN qt0 t USING (slot) GROUP BY id) d USING (id) GROUP BY nn.id)"""


def _sql_levels(parsed: ParsedQuery) -> str:
    """CTE allowed: the rows of the first level of the ladder with enough, with the level l and the bonus."""
    genre = f"list_contains({_sql_list(parsed.genres)}, genre)" if parsed.genres else "true"
    each = [f"{f} {op} {v}" for f, op, v in parsed.filters]
    both = " AND ".join([genre, *each])
    count = " + ".join([*[f"({c})::INT" for c in each], "0"])
    return f"""lvl AS (SELECT CASE WHEN count_if({both}) >= {config.MIN_POOL} THEN 'full' WHEN count_if({genre}) >= {config.MIN_POOL} THEN 'genre_only' ELSE 'unrestricted' END AS l FROM cat),
allowed AS (SELECT cat.*, l, 0.05::DOUBLE * CASE l WHEN 'full' THEN {count} WHEN 'genre_only' THEN {"1" if parsed.genres else "0"} ELSE 0 END AS bonus FROM cat, lvl
  WHERE l = 'unrestricted' OR (l = 'genre_only' AND {genre}) OR (l = 'full' AND {both}))"""


@cache
def _search_sql(text: str) -> str:
    """Exact hybrid search as SQL. The query's own vector, made on the driver, is a literal."""
    parsed, dims = parse.parse_query(text), config.TEXT_DIMS
    q = search.composed_query(vectors.HashEmbedder().vector(text), vectors.query_audio_vector(parsed.filters))
    asked = T.tokens_of(text)
    terms = ", ".join(f"('{x}', {asked.count(x)})" for x in dict.fromkeys(asked))
    slots = ", ".join(f"({i}, {float(x)}::DOUBLE)" for i, x in enumerate(q[:dims]) if x)
    return f"""WITH {_CAT}, q AS (SELECT {[float(x) for x in q[dims:]]}::DOUBLE[] AS audio), qt0(slot, x) AS (VALUES {slots}),
{_sql_embedded()}, {_sql_levels(parsed)},
d AS (SELECT id, {_TOKENS.format("concat_ws(' ', title, artist, genre, replace(mood_tags, '|', ' '))")} AS w FROM cat),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) GROUP BY ALL),
qt(term, times) AS (VALUES {terms}), c AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
s AS (SELECT d.id, coalesce(sum(times * (1 + ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(w) / avgdl)))), 0) AS b
  FROM d CROSS JOIN c LEFT JOIN (p JOIN qt USING (term) JOIN f USING (term)) ON p.id = d.id WHERE d.id IN (SELECT id FROM allowed) GROUP BY d.id),
sn AS (SELECT id, b / (SELECT CASE WHEN max(b) = 0 THEN 1 ELSE max(b) END FROM s) AS bm25 FROM s),
best AS (SELECT allowed.*, cosine, bm25 FROM allowed JOIN cs USING (id) JOIN sn USING (id) ORDER BY cosine DESC, id LIMIT 10),
sc AS (SELECT *, 0.65 * cosine + 0.25 * bm25 + 0.10 * (popularity / 100) + bonus AS score FROM best)
SELECT (row_number() OVER (ORDER BY score DESC, cosine DESC, id))::INT AS rank, id AS track_id, title, artist, genre, round(score, 6) AS score, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25,
round(popularity / 100, 6) AS popularity_norm, l AS filter_level FROM sc"""


@cache
def _recommend_sql(mood: str) -> str:
    """Recommendation from the first three tracks of popularity 60 and more, as SQL."""
    dims = config.TEXT_DIMS
    wide = f"""{_sql_embedded()}, own AS (SELECT id FROM cat WHERE popularity >= 60 ORDER BY row_num LIMIT 3)"""
    base, cosine = wide.split("cs AS (", 1)
    cosine, own = cosine.rsplit(", own AS", 1)
    return f"""WITH {_CAT}, {base} own AS{own},
x AS (SELECT slot, sum(0.6 * w / tn / n) / 3 AS x FROM sl JOIN nn USING (id) WHERE id IN (SELECT id FROM own) GROUP BY slot
  UNION ALL SELECT {dims} + i - 1 AS slot, sum(0.4 * a[i] / n) / 3 AS x FROM nn, range(1, {len(config.AUDIO_FEATURES) + 1}) r(i) WHERE id IN (SELECT id FROM own) GROUP BY i),
u AS (SELECT slot, x / (SELECT sqrt(sum(x * x)) FROM x) AS x FROM x),
q AS (SELECT list(x ORDER BY slot) AS audio FROM u WHERE slot >= {dims}), qt0 AS (SELECT slot, x FROM u WHERE slot < {dims}),
cs AS ({cosine}, {_sql_levels(ParsedQuery("", [], [mood], parse.mood_filters([mood])))},
best AS (SELECT allowed.*, cosine FROM allowed JOIN cs USING (id) WHERE id NOT IN (SELECT id FROM own) ORDER BY cosine DESC, id LIMIT 10),
sc AS (SELECT *, {config.RECOMMEND_W_COSINE} * cosine + {config.RECOMMEND_W_POPULARITY} * (popularity / 100) + bonus AS score FROM best)
SELECT (row_number() OVER (ORDER BY score DESC, cosine DESC, id))::INT AS rank, id AS track_id, title, artist, genre, round(score, 6) AS score, round(cosine, 6) AS cosine,
round(popularity / 100, 6) AS popularity_norm, l AS filter_level FROM sc"""


INDEXED_QUERY, RECOMMEND_MOOD = "fast energetic electronic", "happy"


def _shown(found: DataFrame) -> DataFrame:
    scored = [c for c in ("score", "cosine", "bm25", "popularity_norm") if c in found.columns]
    return found.select("rank", "track_id", "title", "artist", "genre", *[r6(F.col(c), c) for c in scored], "filter_level")


@query(_search_sql(SEARCH_QUERY))
def hybrid_search(t):
    return _shown(search.Engine.build(catalogue(t), indexed=False).search(SEARCH_QUERY))


@query(_search_sql(INDEXED_QUERY))
def hybrid_search_indexed(t):
    return _shown(search.Engine.build(catalogue(t)).search(INDEXED_QUERY))


@query(_recommend_sql(RECOMMEND_MOOD))
def recommend_local(t):
    cat = catalogue(t)
    ids = [r["id"] for r in cat.filter("popularity >= 60").orderBy("row_num").select("id").limit(3).collect()]
    return _shown(search.Engine.build(cat).recommend(ids, RECOMMEND_MOOD))


def _sql_folded(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{_B}+', ' ', 'g'))"


_LIVE_SIM = {f: f"coalesce(CASE WHEN NOT isnan(live.{f}) THEN live.{f} END, 0.5::DOUBLE)" for f in _SIM}
_LIVE_SQL = f"""WITH {_CAT}, {_FAVS}, {_ONE_LIVE},
k AS (SELECT cat.id, title, artist, popularity, duration_ms, {", ".join(f"{x} AS {f}" for f, x in _LIVE_SIM.items())},
  coalesce({" OR ".join(f"(live.{f} IS NOT NULL AND NOT isnan(live.{f}))" for f in _SIM)}, false) AS featured, {_sql_folded("title")} AS ft, {_sql_folded("artist")} AS fa FROM cat LEFT JOIN live USING (id)),
tx AS (SELECT request_id, pos, unnest([title, artist, CASE WHEN length(regexp_extract(trim(title), '^\\S+')) > 3 THEN regexp_extract(trim(title), '^\\S+') END]) AS text, unnest([0, 1, 2]) AS q FROM favs JOIN k USING (id)),
tf AS (SELECT request_id, pos, q, {_sql_folded("text")} AS text FROM tx WHERE trim(text) <> ''),
hits AS (SELECT text, id, row_number() OVER (PARTITION BY text ORDER BY id) AS item FROM (SELECT DISTINCT text FROM tf) d JOIN k ON contains(' ' || ft || ' ', ' ' || text || ' ') OR contains(' ' || fa || ' ', ' ' || text || ' ')),
pool AS (SELECT request_id, id, min({{'p': pos, 'q': q, 'i': item}}) AS seen_at FROM tf JOIN hits USING (text) WHERE item <= 20 GROUP BY request_id, id),
cut AS (SELECT pool.*, top_k, row_number() OVER (PARTITION BY request_id ORDER BY seen_at, id) AS r FROM pool JOIN recommend_requests USING (request_id)),
prof AS (SELECT request_id, {", ".join(f"avg(coalesce({f}, 0.5::DOUBLE)) AS fav_{f}" for f in _SIM)}, avg(coalesce(popularity, 50)) AS fav_popularity,
  avg(coalesce(duration_ms, 180000)) AS fav_duration, coalesce(list(DISTINCT lower(artist)) FILTER (artist <> ''), []) AS fav_artists, list(id) AS fav_ids FROM favs LEFT JOIN k USING (id) GROUP BY request_id),
sc AS (SELECT cut.request_id, cut.id AS track_id, title, artist, popularity, valence, energy, seen_at, top_k, CASE WHEN featured THEN
  0.35 * ({_sql_cosine(_SIM, [f"fav_{f}" for f in _SIM])}) + 0.20 * greatest(0, 1 - abs(popularity - fav_popularity) / 100) + 0.15 * greatest(0, 1 - abs(acousticness - fav_acousticness))
  + 0.10 * ({_sql_duration("fav_duration")}) + 0.20 * (CASE WHEN list_contains(fav_artists, lower(artist)) THEN 0.3 ELSE 1.0 END) ELSE 0.5 END AS score
  FROM cut JOIN k USING (id) JOIN prof USING (request_id) WHERE r <= 3 * top_k AND NOT list_contains(fav_ids, cut.id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, seen_at) AS rank FROM sc)
SELECT request_id, rank::INT AS rank, track_id, title, artist, popularity, concat_ws(',', CASE WHEN valence > 0.6 THEN 'happy,uplifting,playful' END, CASE WHEN valence < 0.4 THEN 'sad,melancholic,nostalgic' END,
  CASE WHEN energy > 0.7 THEN 'energetic,aggressive,tense' END, CASE WHEN energy < 0.4 THEN 'chill,dreamy' END) AS mood_tags, round(score, 6) AS score FROM rk WHERE rank <= top_k"""


@query(_LIVE_SQL)
def recommend_live(t):
    found = search.recommend_live(t("recommend_requests"), catalogue(t), t("live_features"))
    return found.withColumn("score", F.round("score", 6))
