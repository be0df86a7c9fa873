"""The registry of core queries: name -> (plan, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.operators import packed, profile, strict_load
from trackloom.plans import queries_reference
from trackloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile.findings(profile.profile(spark, f"{folder}/tracks.parquet"))


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile(spark, f"{folder}/tracks.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(read_table(spark, folder, "tracks"), "mood_tags", ["row_num"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load.failure_reasons(read_table(spark, folder, "raw_tracks"))


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load.strict_load(read_table(spark, folder, "raw_tracks"))


def p6_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return strict_load.rejected_rows(read_table(spark, folder, "raw_tracks"))


_P1_SQL = """
WITH t AS (SELECT load_id, loudness, popularity::DOUBLE AS popularity, genre FROM tracks),
valid AS (
  SELECT load_id, 'loudness' AS c, loudness AS v FROM t WHERE loudness BETWEEN -60 AND 5
  UNION ALL SELECT load_id, 'popularity', popularity FROM t WHERE popularity BETWEEN 0 AND 100),
own AS (SELECT load_id, c, v, count(*) AS n FROM valid GROUP BY ALL),
every AS (SELECT c, v, sum(n) AS n FROM own GROUP BY ALL),
grid AS (SELECT l.load_id, e.c, e.v, coalesce(o.n, 0) AS n, e.n AS m
  FROM (SELECT DISTINCT load_id FROM t) l CROSS JOIN every e LEFT JOIN own o ON o.load_id = l.load_id AND o.c = e.c AND o.v = e.v),
cum AS (SELECT load_id, c, sum(n) OVER w AS a, sum(m) OVER w AS b, sum(n) OVER p AS na, sum(m) OVER p AS nb FROM grid
  WINDOW w AS (PARTITION BY load_id, c ORDER BY v), p AS (PARTITION BY load_id, c)),
ks AS (SELECT load_id, c, max(abs(a / na - (b - a) / (nb - na))) AS d FROM cum WHERE na > 0 AND nb > na GROUP BY ALL),
g AS (SELECT load_id, genre AS v, count(*) AS n FROM t WHERE regexp_full_match(genre, '[a-z]+([-&][a-z]+)?') GROUP BY ALL),
gall AS (SELECT v, sum(n) AS m FROM g GROUP BY v),
ggrid AS (SELECT l.load_id, a.v, coalesce(g.n, 0) AS n, a.m FROM (SELECT DISTINCT load_id FROM g) l CROSS JOIN gall a LEFT JOIN g ON g.load_id = l.load_id AND g.v = a.v),
gtot AS (SELECT load_id, sum(n) AS nl, sum(m) AS mt FROM ggrid GROUP BY ALL),
tv AS (SELECT load_id, 'genre' AS c, sum(abs(n / nl - (m - n) / (mt - nl))) / 2 AS d FROM ggrid JOIN gtot USING (load_id) WHERE mt > nl GROUP BY ALL),
long AS (
  SELECT load_id, 'loudness' AS c, loudness IS NULL AS nul, loudness IS NOT NULL AND NOT (loudness BETWEEN -60 AND 5) AS bad FROM t
  UNION ALL SELECT load_id, 'popularity', popularity IS NULL, popularity IS NOT NULL AND NOT (popularity BETWEEN 0 AND 100) FROM t
  UNION ALL SELECT load_id, 'genre', genre IS NULL, genre IS NOT NULL AND NOT regexp_full_match(genre, '[a-z]+([-&][a-z]+)?') FROM t),
s AS (SELECT load_id, c, count(*) AS n, count_if(nul) AS k, bool_or(bad) AS bad FROM long GROUP BY ALL),
z AS (SELECT *, sum(n) OVER (PARTITION BY c) AS nn, sum(k) OVER (PARTITION BY c) AS kk FROM s)
SELECT load_id, c AS column_name, 'nulls' AS finding FROM z WHERE nn > n AND k / n > (kk - k) / (nn - n) + 0.08
UNION ALL SELECT load_id, c, CASE c WHEN 'genre' THEN 'pattern' ELSE 'range' END FROM z WHERE bad
UNION ALL SELECT load_id, c, 'distribution' FROM (SELECT * FROM ks UNION ALL SELECT * FROM tv) WHERE d > 0.25
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_NUMBER = r"[\s\x{a0}]*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[\s\x{a0}]*"


def _p6_sql() -> str:
    from trackloom.schema import RECORD_FIELDS, RULES

    checks = []
    for i, f in enumerate(RECORD_FIELDS, 1):
        rule, text = RULES[f], f"f[{i}]"
        if rule.kind == "text":
            checks.append(f"CASE WHEN regexp_full_match({text}, '(?s)[\\s\\x{{a0}}]*') THEN '{f}' END")
        elif rule.kind != "optional":
            number = f"try_cast(regexp_replace({text}, '[\\s\\x{{a0}}]', '', 'g') AS DOUBLE)"
            number = f"trunc({number})" if rule.kind == "whole" else number
            bounds = f"{number} {'>' if rule.open_low else '>='} {rule.low}" + (f" AND {number} <= {rule.high}" if rule.high is not None else "")
            checks.append(f"CASE WHEN NOT coalesce(regexp_full_match({text}, '{_NUMBER}') AND {bounds}, false) THEN '{f}' END")
    return f"""
WITH l AS (SELECT line_id, coalesce(raw_line, '') AS x FROM raw_tracks),
q AS (SELECT line_id, x, regexp_full_match(x, '(?s){_FIELD}(?:,{_FIELD})*') AS sound FROM l),
s AS (SELECT line_id, sound, list_transform(regexp_extract_all(',' || x, '(?s),({_FIELD})', 1),
  lambda p: CASE WHEN p[1] = '"' THEN replace(p[2:-2], '""', '"') ELSE p END) AS f FROM q)
SELECT line_id, 'quoting' AS reason FROM s WHERE NOT sound
UNION ALL SELECT line_id, 'column_count' FROM s WHERE sound AND len(f) <> {len(RECORD_FIELDS)}
UNION ALL SELECT line_id, reason FROM (SELECT line_id, unnest([{", ".join(checks)}]) AS reason FROM s WHERE sound AND len(f) = {len(RECORD_FIELDS)}) WHERE reason IS NOT NULL
"""


def core_queries() -> dict[str, Query]:
    own = {f.__name__: f for f in (p1_found, p1_profile, p2_found, p6_found, p6_loaded, p6_rejected)}
    return own | {name: plan for name, (plan, _) in queries_reference.registry().items()}


def core_sql() -> dict[str, str]:
    return {"p1_found": _P1_SQL, "p6_found": _p6_sql()} | {name: sql for name, (_, sql) in queries_reference.registry().items() if sql}
