"""String to number coercion with the grammar of the feeds, and range tests, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.schema import Rule
from trackloom.session import BLANKS

# Decimal numbers with optional sign and exponent; words for infinite values and for "not a number".
NUMBER = r"\A[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\z"
WORDS = r"\A[+-]?(?:inf|infinity|nan)\z"


def stripped(column: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(column, rf"\A{BLANKS}|{BLANKS}\z", "")


def is_blank(column: Column) -> Column:
    """Null, empty or blanks only."""
    seen = F.coalesce(column.rlike(r"\A[!-~]"), F.lit(False))  # most texts begin with a visible ASCII character
    return F.when(seen, False).otherwise(F.coalesce(stripped(column), F.lit("")) == "")


def to_real(column: Column) -> Column:
    """Double, or null where the text is not a number.

    Blanks around it, a sign, an exponent, single underscores between digits and the words nan and inf are allowed; a trailing
    type letter (0.5f), hexadecimal digits, a decimal comma and a unit are not.
    """
    text = stripped(column)
    plain = F.regexp_replace(text, "_", "")
    simple = column.rlike(r"\A-?\d{1,15}(?:\.\d{1,15})?\z")  # the common case, tried first
    return F.when(simple, column.try_cast("double")).when(text.rlike(NUMBER), plain.try_cast("double")).when(
        F.lower(text).rlike(WORDS), F.regexp_replace(F.lower(text), r"\A\+", "").try_cast("double")
    )


def to_whole(column: Column) -> Column:
    """Bigint, truncated towards zero, or null where the text is not a finite number that fits."""
    real = to_real(column)
    return F.when(~F.isnan(real), real).try_cast("bigint")


def in_range(value: Column, rule: Rule) -> Column:
    """Whether a number meets a rule; NaN and null never do."""
    ok = value.isNotNull() & ~F.isnan(value.cast("double"))
    if rule.low is not None:
        ok = ok & ((value > rule.low) if rule.open_low else (value >= rule.low))
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return F.coalesce(ok, F.lit(False))


def field_valid(column: Column, rule: Rule) -> Column:
    """Whether the text of a field meets its rule; never null."""
    if rule.kind == "optional":
        return F.lit(True)
    if rule.kind == "text":
        return ~is_blank(column)
    return in_range(to_real(column) if rule.kind == "real" else to_whole(column), rule)
