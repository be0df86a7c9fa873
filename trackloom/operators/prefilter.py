"""Predicates from parsed queries, and the ladder that relaxes them until enough rows match."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import MIN_POOL
from trackloom.functions.parse import FeatureFilter, ParsedQuery, checked

LEVELS = ["full", "genre_only", "unrestricted"]


def filter_condition(filters: list[FeatureFilter]) -> Column:
    """All filters together, strict; true for none."""
    for f in filters:
        checked(*f[:2])
    return reduce(Column.__and__, [F.col(f) > t if op == ">" else F.col(f) < t for f, op, t in filters], F.lit(True))


def genre_condition(genres: list[str]) -> Column:
    """Any of the genres; true for none named."""
    return F.col("genre").isin(genres) if genres else F.lit(True)


def level_condition(query: ParsedQuery, level: str) -> Column:
    """The predicate of a level."""
    if level == "full":
        return genre_condition(query.genres) & filter_condition(query.filters)
    return genre_condition(query.genres) if level == "genre_only" else F.lit(True)


@dataclass(frozen=True)
class Prefiltered:
    """The rows allowed, the level reached, and the predicates that count towards the bonus."""

    rows: DataFrame
    level: str
    genres: list[str]
    filters: list[FeatureFilter]


def relaxed(tracks: DataFrame, query: ParsedQuery, least: int = MIN_POOL) -> Prefiltered:
    """The first level with at least `least` rows, else all rows.

    One counting pass over both predicates decides; the chosen one is then a plain filter again and reaches the scan.
    At the level full its filters count for the bonus, at genre_only its genres, at unrestricted nothing.
    """
    counts = tracks.agg(*[F.count_if(level_condition(query, level)).alias(level) for level in LEVELS[:2]]).first()
    level = next((x for x in LEVELS[:2] if counts[x] >= least), "unrestricted")
    rows = tracks if level == "unrestricted" else tracks.filter(level_condition(query, level))
    return Prefiltered(rows, level, query.genres if level == "genre_only" else [], query.filters if level == "full" else [])


def satisfied(prefiltered: Prefiltered) -> Column:
    """How many of the counting predicates a row meets."""
    hits = [F.when(F.col("genre") == g, 1).otherwise(0) for g in prefiltered.genres]
    hits += [F.when(filter_condition([f]), 1).otherwise(0) for f in prefiltered.filters]
    return reduce(Column.__add__, hits, F.lit(0))
