"""A synthetic catalogue: features around a genre's centre, weighted mood tags, and injected defects and duplicates.

Seeded and made in parallel; not the same rows as another random generator would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.schema import RECORD_FIELDS
from trackloom.vocab import GENRES, MOOD_HINTS, MOODS

# Made-up words for titles and artists.
ADJECTIVES = ["Hollow", "Bright", "Velvet", "Quiet", "Crooked", "Amber", "Northern", "Paper"]
NOUNS = ["River", "Lantern", "Mirror", "Harbour", "Orchard", "Signal", "Garden", "Window"]
FIRST, LAST = ["Ada", "Bo", "Cleo", "Dov", "Esme", "Finn"], ["Ashby", "Brook", "Crane", "Dale", "Ember", "Fox"]
DEFECTS = ["title", "artist", "genre", "valence", "tempo", "duration_ms", "mode"]
BAD = {"title": "", "artist": "", "genre": "", "valence": "1.8", "tempo": "-5.0", "duration_ms": "-1000", "mode": "7"}


def _pick(words: list[str], seed: int) -> Column:
    return F.element_at(F.lit(words), (F.floor(F.rand(seed) * len(words)) + 1).cast("int"))


def _around(centre: Column, spread: float, low: float, high: float, seed: int, digits: int) -> Column:
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), centre + F.randn(seed) * spread)), digits)


def _centre(shift: int, low: float, high: float) -> Column:
    """A genre's centre: spread evenly over the range, in another order for every feature."""
    return F.lit(low) + (high - low) * F.pmod(F.col("_g") * shift + shift, F.lit(len(GENRES))) / float(len(GENRES))


def _mood_tags(seed: int) -> Column:
    """One to three draws without repeats; moods that fit valence and energy weigh three times as much."""
    value = {"valence": F.col("valence"), "energy": F.col("energy")}
    weights = []
    for m in MOODS:
        hint = next(((f, op, t) for group, f, op, t in MOOD_HINTS if m in group), None)
        fits = F.lit(False) if hint is None else (value[hint[0]] > hint[2] if hint[1] == ">" else value[hint[0]] < hint[2])
        weights.append(F.when(fits, 3.0).otherwise(1.0))
    total = sum(weights, F.lit(0.0))

    def draw(s: int) -> Column:
        at, picked = F.rand(s) * total, F.lit(MOODS[-1])
        for m, w in reversed(list(zip(MOODS, _running(weights)))):
            picked = F.when(at < w, m).otherwise(picked)
        return picked

    times = F.element_at(F.lit([1, 2, 2, 3]), (F.floor(F.rand(seed + 9) * 4) + 1).cast("int"))
    return F.array_join(F.array_distinct(F.slice(F.array(draw(seed), draw(seed + 1), draw(seed + 2)), F.lit(1), times)), "|")


def _running(weights: list[Column]) -> list[Column]:
    out, total = [], F.lit(0.0)
    for w in weights:
        total = total + w
        out.append(total)
    return out


def generate(spark: SparkSession, rows: int, seed: int = 42, defect_rate: float = 0.02, duplicate_rate: float = 0.005) -> DataFrame:
    """(row_num, the record fields as strings)."""
    base = spark.range(1, rows + 1).select(F.col("id").alias("row_num"), F.floor(F.rand(seed) * len(GENRES)).cast("int").alias("_g"))
    numbers = {
        f: _around(_centre(k + 1, 0.2, 0.8), 0.12, 0.0, 1.0, seed + k, 3)
        for k, f in enumerate(["danceability", "energy", "valence", "acousticness", "instrumentalness"], 1)
    }
    hip_hop = F.when(F.col("_g") == GENRES.index("hip-hop"), 0.2).otherwise(0.06)
    numbers |= {
        "speechiness": _around(hip_hop, 0.05, 0.0, 1.0, seed + 11, 3), "liveness": _around(F.lit(0.15), 0.1, 0.0, 1.0, seed + 12, 3),
        "tempo": _around(_centre(5, 80.0, 150.0), 12.0, 40.0, 220.0, seed + 13, 1), "loudness": _around(_centre(3, -16.0, -4.0), 2.5, -60.0, 0.0, seed + 14, 2),
        "duration_ms": _around(F.lit(215000.0), 40000.0, 60000.0, 480000.0, seed + 15, 0).cast("int"), "key": F.floor(F.rand(seed + 16) * 12),
        "mode": F.floor(F.rand(seed + 17) * 2), "time_signature": F.element_at(F.lit([3, 4, 4, 4, 5]), (F.floor(F.rand(seed + 18) * 5) + 1).cast("int")),
        "popularity": _around(F.lit(45.0), 20.0, 0.0, 100.0, seed + 19, 0).cast("int"),
    }
    # Ids of a duplicated row are those of the row before it.
    copied = F.when((F.rand(seed + 20) < duplicate_rate) & (F.col("row_num") > 1), F.col("row_num") - 1).otherwise(F.col("row_num"))
    made = base.withColumns(numbers).withColumns({
        "id": F.substring(F.sha2(F.concat_ws("/", F.lit(str(seed)), copied), 256), 1, 22), "genre": F.element_at(F.lit(GENRES), F.col("_g") + 1),
        "title": F.concat_ws(" ", _pick(ADJECTIVES, seed + 21), _pick(NOUNS, seed + 22)),
        "artist": F.when(F.rand(seed + 23) < 0.15, F.concat(F.lit("The "), _pick(NOUNS, seed + 24), F.lit("s"))).otherwise(F.concat_ws(" ", _pick(FIRST, seed + 25), _pick(LAST, seed + 26))),
    })
    made = made.withColumn("mood_tags", _mood_tags(seed + 30))
    strings = made.select("row_num", *[F.col(f).cast("string").alias(f) for f in RECORD_FIELDS], F.when(F.rand(seed + 40) < defect_rate, _pick(DEFECTS, seed + 41)).alias("_bad"))
    return strings.withColumns({f: F.when(F.col("_bad") == f, BAD[f]).otherwise(F.col(f)) for f in DEFECTS}).drop("_bad")
