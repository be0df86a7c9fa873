"""Component scores of reranking, each in [0, 1], as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.config import DEFAULT_DURATION, DEFAULT_FEATURE, DEFAULT_POPULARITY


def _floored(score: Column) -> Column:
    return F.greatest(F.lit(0.0), score)


def popularity_alignment(popularity: Column, mean: Column) -> Column:
    """1 minus the gap over 100; 0.5 where there are no favourites (a null mean)."""
    gap = F.abs(F.coalesce(popularity, F.lit(DEFAULT_POPULARITY)) - mean) / 100
    return F.when(mean.isNull(), 0.5).otherwise(_floored(1 - gap))


def acoustic_alignment(acousticness: Column, mean: Column) -> Column:
    """1 minus the gap; 0.5 without favourites."""
    return F.when(mean.isNull(), 0.5).otherwise(_floored(1 - F.abs(F.coalesce(acousticness, F.lit(DEFAULT_FEATURE)) - mean)))


def duration_alignment(duration: Column, mean: Column) -> Column:
    """1 for half to twice the mean; beyond, 1 minus what the ratio's distance from 1 has over 0.5. A mean of 0 or less: 1."""
    ratio = F.when(mean > 0, F.coalesce(duration, F.lit(DEFAULT_DURATION)) / mean).otherwise(1.0)
    outside = _floored(1 - _floored(F.abs(ratio - 1) - 0.5))
    return F.when(mean.isNull(), 0.5).when(ratio.between(0.5, 2.0), 1.0).otherwise(outside)


def artist_freshness(names: Column, favourites: Column) -> Column:
    """0.3 if an artist is among the favourites', 1 if all are new, 0.5 without artists. Both arrays in lower case."""
    return F.when(F.size(F.array_intersect(names, favourites)) > 0, 0.3).when(F.size(names) > 0, 1.0).otherwise(0.5)


def clipped_cosine(left: list[Column], right: list[Column]) -> Column:
    """Cosine in [0, 1]; nulls count as 0.5, a vector of zeros gives 0.5."""
    a, b = ([F.coalesce(c.cast("double"), F.lit(DEFAULT_FEATURE)) for c in side] for side in (left, right))
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    norms = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((y * y for y in b), F.lit(0.0)))
    return F.when(norms == 0, 0.5).otherwise(F.least(F.lit(1.0), _floored(dot / norms)))
