"""Row validation: every error of a row in a fixed order, duplicates by id, quarantine and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.text import error_category
from trackloom.operators.coerce import in_range, is_blank, stripped, to_real, to_whole
from trackloom.schema import ERROR_ORDER, RECORD_FIELDS, RULES
from trackloom.session import computed_once

#: Parts of a repeated id.
SALTS = 16


def quoted(text: Column) -> Column:
    """A text as it stands in an error: in quote marks, None for null."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), plain, F.lit('"'))
    return F.when(text.isNull(), F.lit("None")).when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(single)


def number_text(value: Column, kind: str) -> Column:
    """A number as it stands in an error: nan and inf in small letters."""
    if kind == "whole":
        return value.cast("string")
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(value.cast("string"))


def numbers_of() -> dict[str, Column]:
    """_v_<field>: the number in each numeric field of a raw row, null where there is none."""
    return {f"_v_{f}": to_real(F.col(f)) if RULES[f].kind == "real" else to_whole(F.col(f)) for f in ERROR_ORDER if RULES[f].kind != "text"}


def field_error(field: str) -> Column:
    """The error of one field of a raw row with numbers_of, null if there is none. An infinite whole number is not numeric."""
    rule, text = RULES[field], F.col(field)
    if rule.kind == "text":
        return F.when(is_blank(text), F.lit(f"{field} is missing/empty"))
    value = F.col(f"_v_{field}")
    shown = F.concat(F.lit(f"{field}="), number_text(value, rule.kind))
    limits = {"duration_ms": " must be positive", "mode": " must be 0 or 1", "tempo": " out of range (0,300]"}
    limit = limits.get(field) or f" out of range [{rule.low:g},{rule.high:g}]"
    return F.when(value.isNull(), F.concat(F.lit(f"{field} is not numeric: "), quoted(text))).when(~in_range(value, rule), F.concat(shown, F.lit(limit)))


def row_errors() -> Column:
    """array<string> of the errors of a raw row with numbers_of, in ERROR_ORDER; duplicates apart."""
    return F.array_compact(F.array(*[field_error(f) for f in ERROR_ORDER]))


def duplicate_flags(raw: DataFrame, row: str, key: str = "id") -> DataFrame:
    """(row, duplicate): whether an earlier row has the same stripped, non-empty id, be that row valid or not.

    The earliest row of each id is found by a map-side minimum; only ids that occur again are joined back, each cut in SALTS parts,
    so an id with very many rows is in no step the work of one task. Rows with a blank id take no part in the join.
    """
    own = raw.select(F.col(row), stripped(F.col(key)).alias("_id"))
    named = F.coalesce("_id", F.lit("")) != ""
    again = own.filter(named).groupBy("_id").agg(F.min(row).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = again.select("_id", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = own.filter(named).withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    joined = salted.join(again, ["_id", "_salt"], "left").select(row, F.coalesce(F.col(row) > F.col("_first"), F.lit(False)).alias("duplicate"), "_id")
    return joined.unionByName(own.filter(~named).select(row, F.lit(False).alias("duplicate"), "_id"))


def validated(raw: DataFrame, row: str = "row_num") -> DataFrame:
    """raw (all strings, and a unique row number) with errors array<string>: the row's own, then its duplicate id."""
    flags = duplicate_flags(raw, row)
    numbers = numbers_of()
    own = computed_once(computed_once(raw, numbers), {"_errors": row_errors()}).drop(*numbers)
    repeated = F.when(F.col("duplicate"), F.array(F.concat(F.lit("duplicate id: "), F.col("_id")))).otherwise(F.array().cast("array<string>"))
    return own.join(flags, row).withColumn("errors", F.concat("_errors", repeated)).drop("_errors", "duplicate", "_id")


def accepted(checked: DataFrame, row: str = "row_num") -> DataFrame:
    """Typed rows without errors."""
    typed = []
    for f in RECORD_FIELDS:
        kind, text = RULES[f].kind, F.col(f)
        value = to_real(text) if kind == "real" else to_whole(text) if kind == "whole" else F.coalesce(stripped(text), F.lit(""))
        typed.append((value.try_cast("int") if kind == "whole" and f != "duration_ms" else value).alias(f))
    return checked.filter(F.size("errors") == 0).select(row, *typed)


def rejected(checked: DataFrame, row: str = "row_num") -> DataFrame:
    """(row, raw_json, errors): quarantined rows as JSON of their raw fields, errors joined by '; '."""
    raw = F.to_json(F.struct(*[F.col(f) for f in RECORD_FIELDS]), {"ignoreNullFields": "false"})
    return checked.filter(F.size("errors") > 0).select(row, raw.alias("raw_json"), F.array_join("errors", "; ").alias("errors"))


def reject_histogram(checked: DataFrame, top: int = 10) -> DataFrame:
    """(category, n) of the most frequent errors; one per error, ties by name."""
    each = checked.select(F.explode("errors").alias("_e")).select(error_category(F.col("_e")).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def reject_sample(checked: DataFrame, row: str = "row_num", n: int = 10) -> DataFrame:
    """The first n rejected rows: a report, not a cut of the data."""
    return rejected(checked, row).select(row, "errors").orderBy(row).limit(n)


def load_summary(checked: DataFrame) -> DataFrame:
    """One row (total, loaded, rejected)."""
    bad = F.size("errors") > 0
    return checked.agg(F.count("*").alias("total"), F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("rejected"))


def valid_columns() -> Column:
    """Whether a typed track row meets every rule."""
    ok = F.lit(True)
    for f, rule in RULES.items():
        if rule.kind == "text":
            ok = ok & ~is_blank(F.col(f))
        elif rule.kind != "optional":
            ok = ok & in_range(F.col(f), rule)
    return ok


def catalogue(tracks: DataFrame) -> DataFrame:
    """The rows of a typed table that a load would accept: valid, and the first of their id."""
    flags = duplicate_flags(tracks, "row_num").filter(~F.col("duplicate")).select("row_num")
    return tracks.filter(valid_columns()).join(flags, "row_num", "left_semi").withColumn("mood_tags", F.coalesce("mood_tags", F.lit("")))


# What an external feature becomes if it is missing, and its range.
CLAMPS = {
    **{f: (0.5, 0.0, 1.0) for f in ("danceability", "energy", "valence")}, "tempo": (120.0, 1.0, None), "loudness": (-5.0, -60.0, 5.0),
    **{f: (0.0, 0.0, 1.0) for f in ("speechiness", "acousticness", "instrumentalness", "liveness")},
}


def clamped_features(features: DataFrame) -> DataFrame:
    """External features brought into the ranges of the schema; null and NaN become the default. Keys wrap round at 12."""
    out = {}
    for f, (default, low, high) in CLAMPS.items():
        value = F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(default))
        value = F.greatest(F.lit(low), value)
        out[f] = F.least(F.lit(high), value) if high is not None else value
    out["key"] = F.pmod(F.coalesce("key", F.lit(0)), F.lit(12))
    out["mode"] = F.coalesce("mode", F.lit(1))
    return features.withColumns(out)


