"""Text functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.session import blanks_collapsed
from trackloom.vocab import MOOD_HINTS, MOOD_KEYWORDS

TOKEN = "[a-z']+"


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and apostrophes; digits, hyphens and accented letters separate. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The same on the driver."""
    import re

    return re.findall(TOKEN, text.lower())


def folded(text: Column) -> Column:
    """A name without regard to letter case and to leading, trailing or repeated blanks."""
    return blanks_collapsed(F.lower(text))


def word_runs(text: Column) -> Column:
    """All runs of consecutive words of a name, folded; empty for null and blank."""
    words = F.filter(F.split(folded(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i > 0)
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))


def lexical_tokens(title: Column, artist: Column, genre: Column, mood_tags: Column) -> Column:
    """Tokens of a track's lexical document, in this order; bars between tags separate."""
    return tokens(F.concat_ws(" ", title, artist, genre, F.replace(mood_tags, F.lit("|"), F.lit(" "))))


def semantic_text(genre: Column, mood_tags: Column) -> Column:
    """'<genre> music that feels a, b', or '<genre> music' without tags. Nulls count as empty, blank tags are dropped."""
    genre = F.trim(F.coalesce(genre, F.lit("")))
    moods = F.filter(F.transform(F.split(F.coalesce(mood_tags, F.lit("")), r"\|"), lambda m: F.trim(m)), lambda m: m != "")
    return F.when(F.size(moods) > 0, F.concat(genre, F.lit(" music that feels "), F.array_join(moods, ", "))).otherwise(F.concat(genre, F.lit(" music")))


def derive_tags(valence: Column, energy: Column) -> Column:
    """Comma-joined mood words whose threshold is met, strictly; '' for none. Null and NaN meet none."""
    value = {"valence": valence, "energy": energy}
    groups = []
    for moods, feature, op, threshold in MOOD_HINTS:
        v = F.nullif(value[feature].cast("double"), F.lit(float("nan")))
        met = v > threshold if op == ">" else v < threshold
        groups.append(F.when(met, F.lit(",".join(moods))))
    return F.concat_ws(",", *groups)


def mood_targets(mood: Column) -> Column:
    """Map of feature to the middle between a mood's threshold and the open end of its range; empty for other moods."""
    rows = []
    for moods, feature, op, threshold in MOOD_HINTS:
        middle = (threshold + 1.0) / 2.0 if op == ">" else threshold / 2.0
        rows.append((moods, F.create_map(F.lit(f"target_{feature}"), F.lit(middle))))
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return reduce(lambda rest, r: F.when(mood.isin(r[0]), r[1]).otherwise(rest), reversed(rows), empty)


def expand_queries(title: Column, artist: Column, mood: Column | None = None) -> Column:
    """Up to five search texts: title, artist, the mood's keywords, 'artist mood', the title's first word if longer than 3.

    Null, empty and blank titles and artists are left out.
    """
    mood = F.lit(None).cast("string") if mood is None else F.nullif(mood, F.lit(""))
    keywords = F.create_map(*[F.lit(x) for kv in MOOD_KEYWORDS.items() for x in kv])
    title, artist = (F.when(F.trim(c) != "", c) for c in (title, artist))
    first = F.element_at(F.split(F.trim(title), r"\s+"), 1)
    found = F.array(title, artist, F.try_element_at(keywords, mood), F.concat(artist, F.lit(" "), mood), F.when(F.length(first) > 3, first))
    return F.slice(F.array_compact(found), 1, 5)


def joined_artists(artists: Column) -> Column:
    """Names of an array<struct<name>> joined by ', '; a null name and an empty or null array give 'Unknown'."""
    names = F.array_join(F.transform(artists, lambda a: F.coalesce(a["name"], F.lit("Unknown"))), ", ")
    return F.when(F.size(artists) > 0, names).otherwise("Unknown")


def artist_names(artists: Column) -> Column:
    """Lower-case names without null and empty ones, distinct."""
    return F.array_distinct(F.filter(F.transform(artists, lambda a: F.lower(a["name"])), lambda n: n.isNotNull() & (n != "")))


def error_category(error: Column) -> Column:
    """An error's text before '=', ' is' or ':'."""
    return F.regexp_extract(error, r"(?s)\A(.*?)(?:=| is|:|\z)", 1)
