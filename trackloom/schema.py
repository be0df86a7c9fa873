"""The track schema and the one rule table that drives coercion, validation, strict loading and profiling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """What a valid value of a field is. kind: text (not blank), optional, real or whole."""

    field: str
    kind: str
    low: float | None = None
    high: float | None = None
    open_low: bool = False


# The order of the fields in a record, and the range of each.
RECORD_FIELDS = [
    "id", "title", "artist", "genre", "mood_tags", "danceability", "energy", "valence", "tempo", "loudness", "speechiness",
    "acousticness", "instrumentalness", "liveness", "duration_ms", "key", "mode", "time_signature", "popularity",
]
UNIT_FIELDS = ["danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness"]
RULES = {
    **{f: Rule(f, "text") for f in ("id", "title", "artist", "genre")},
    "mood_tags": Rule("mood_tags", "optional"),
    **{f: Rule(f, "real", 0, 1) for f in UNIT_FIELDS},
    "tempo": Rule("tempo", "real", 0, 300, open_low=True),
    "loudness": Rule("loudness", "real", -60, 5),
    "duration_ms": Rule("duration_ms", "whole", 0, None, open_low=True),
    "key": Rule("key", "whole", 0, 11),
    "mode": Rule("mode", "whole", 0, 1),
    "time_signature": Rule("time_signature", "whole", 3, 7),
    "popularity": Rule("popularity", "whole", 0, 100),
}
# Fixed value: the order in which a record's errors are listed.
ERROR_ORDER = ["id", "title", "artist", "genre", *UNIT_FIELDS, "tempo", "loudness", "duration_ms", "key", "mode", "time_signature", "popularity"]

SPARK_TYPES = {"text": T.StringType(), "optional": T.StringType(), "real": T.DoubleType(), "whole": T.IntegerType()}
RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])
TRACK_SCHEMA = T.StructType([T.StructField(f, T.LongType() if f == "duration_ms" else SPARK_TYPES[RULES[f].kind]) for f in RECORD_FIELDS])
