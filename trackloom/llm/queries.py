"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import cap, clusters, leak, mixture, neighbours, pii
from trackloom.session import read_table

#: The cap is this part of all rows of tracks, as one over a whole number.
CAP_PER = 100


def _popularity():
    """Valid popularity; null comes last."""
    return F.when(F.col("popularity").between(0, 100), F.col("popularity"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    tracks = read_table(spark, folder, "tracks")
    return cap.cap_share(tracks, cap.contributor_key(F.col("artist")), _popularity(), "row_num", CAP_PER).select("row_num")


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    tracks = read_table(spark, folder, "tracks")
    removed = cap.cap_share(tracks, cap.contributor_key(F.col("artist")), _popularity(), "row_num", CAP_PER)
    return tracks.select("row_num", "artist", "popularity").join(removed.select("row_num"), "row_num", "left_anti")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.probe_neighbours(read_table(spark, folder, "tracks"), read_table(spark, folder, "probe_tracks"))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.all_neighbours(read_table(spark, folder, "tracks"))


def p4_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """In 64 dimensions, where the hypothesis tests abandon: queries are the vectors whose id is divisible by 20, against all."""
    return neighbours.embedding_neighbours(read_table(spark, folder, "embeddings"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.anchored_groups(read_table(spark, folder, "tracks"), read_table(spark, folder, "anchor_tracks"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = max(1, read_table(spark, folder, "anchor_tracks").count())
    assigned, _ = clusters.track_groups(read_table(spark, folder, "tracks"), groups)
    return clusters.describe(assigned, "row_num")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


#: A curriculum over the sources of mix_targets: large records first, committees in the middle, small sources towards the end.
CURRICULUM = {
    "plenary_record": [(0.0, 2.0), (0.6, 1.0), (1.0, 0.25)],
    "upper_house": [(0.0, 1.5), (1.0, 0.5)],
    "committee_record": [(0.0, 0.25), (0.5, 2.0), (1.0, 0.25)],
    "written_answers": [(0.0, 0.0), (0.2, 0.0), (1.0, 2.0)],
}


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.unreachable_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), schedules=CURRICULUM)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), schedules=CURRICULUM)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.reached_shares(p8_mixture(spark, folder), read_table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_details(read_table(spark, folder, "documents"), read_table(spark, folder, "members"))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return pii.redact(documents.select("doc_id", "text"), pii.fit(documents, read_table(spark, folder, "members")))


_RANKED = r"""
WITH t AS (SELECT row_num, artist, popularity, nullif(lower(trim(regexp_replace(artist, '[\s\x{a0}]+', ' ', 'g'))), '') AS a,
  CASE WHEN popularity BETWEEN 0 AND 100 THEN popularity END AS p FROM tracks),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC NULLS LAST, row_num) AS k, count(*) OVER () // 100 AS cap FROM t)
"""
_VECTORS = """
WITH f AS (SELECT id, arg_min({'r': row_num, 'a': danceability, 'b': energy, 'c': valence, 'd': acousticness}, row_num) AS s FROM tracks WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT id, s.r AS r, s.a AS a, s.b AS b, s.c AS c, s.d AS d FROM f
  WHERE s.a BETWEEN 0 AND 1 AND s.b BETWEEN 0 AND 1 AND s.c BETWEEN 0 AND 1 AND s.d BETWEEN 0 AND 1)
"""
_P4_SQL = """
SELECT probe_id, r AS row_num FROM (
  SELECT p.probe_id, v.r, row_number() OVER (PARTITION BY p.probe_id ORDER BY (v.a - u.a) ** 2 + (v.b - u.b) ** 2 + (v.c - u.c) ** 2 + (v.d - u.d) ** 2, v.r) AS k
  FROM probe_tracks p JOIN v u ON u.id = p.track_id JOIN v ON v.id <> u.id) WHERE k <= 10
"""
_P4_ALL_SQL = """
, n AS (SELECT u.r AS row_num, min({'d': round((u.a - v.a) ** 2 + (u.b - v.b) ** 2 + (u.c - v.c) ** 2 + (u.d - v.d) ** 2, 12), 'r': v.r}, 10) AS best
  FROM v u JOIN v ON v.r <> u.r GROUP BY u.r),
e AS (SELECT row_num, unnest(best) AS b, unnest(range(1, len(best) + 1)) AS rank FROM n)
SELECT row_num, b.r AS neighbour, CAST(rank AS INT) AS rank, round(sqrt(b.d), 9) AS distance FROM e
"""
# Which source falls short does not depend on the measure of size: SQL takes characters for tokens.
_P8_SQL = """
WITH s AS (SELECT source, sum(length(text)) AS size FROM documents GROUP BY source), a AS (SELECT sum(size) AS total FROM s)
SELECT t.source FROM mix_targets t CROSS JOIN a LEFT JOIN s USING (source) WHERE t.target_share * a.total > t.max_repeats * coalesce(s.size, 0)
"""


def llm_queries() -> dict:
    plans = (p3_found, p3_kept, p4_found, p4_neighbours, p4_embeddings, p5_found, p5_groups, p7_found, p8_found, p8_mixture, p8_shares, p9_found, p9_redacted)
    return {f.__name__: f for f in plans}


def llm_sql() -> dict[str, str]:
    return {
        "p3_found": _RANKED + "SELECT row_num FROM r WHERE a IS NOT NULL AND k > cap",
        "p3_kept": _RANKED + "SELECT row_num, artist, popularity FROM r WHERE a IS NULL OR k <= cap",
        "p4_found": _VECTORS + _P4_SQL,
        "p4_neighbours": _VECTORS + _P4_ALL_SQL,
        "p8_found": _P8_SQL,
    }
