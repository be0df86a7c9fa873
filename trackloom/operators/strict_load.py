"""Rows that fail to parse: load what conforms, subtract it from the offsets, diagnose the rest.

Every raw line keeps its offset. The strict load reads only lines that have exactly the wanted fields, sound quoting and valid
values. An anti-join on the offset subtracts the loaded lines; only what is left, the small part, goes through the diagnosis.
All of it is JVM-side: the record grammar is one regular expression with possessive repeats, so it needs no backtracking and no
stack that grows with the length of a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.coerce import in_range, is_blank, stripped, to_real
from trackloom.operators.validate import numbers_of, row_errors
from trackloom.schema import RECORD_FIELDS, RULES
from trackloom.session import computed_once

# One enclosed field, one bare field, and a record of them.
ENCLOSED = r'"[^"]*+(?:""[^"]*+)*+"'
BARE = r'[^",]*+'
FIELD = rf"(?:{ENCLOSED}|{BARE})"
WELL_QUOTED = rf"(?s)\A{FIELD}(?:,{FIELD})*+\z"


def well_quoted(line: Column) -> Column:
    """Whether every quote mark of a record opens, closes or doubles as it should."""
    return F.coalesce(line, F.lit("")).rlike(WELL_QUOTED)


def split_record(line: Column) -> Column:
    """The fields of a well-quoted record, without enclosing quotes; doubled quotes inside stand for one."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.coalesce(line, F.lit(""))), F.lit(rf"(?s),({FIELD})"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.when(p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p),
    )


def strict_load(raw: DataFrame, offset: str = "line_id", line: str = "raw_line", fields: list[str] = RECORD_FIELDS) -> DataFrame:
    """The typed rows of all lines that conform: offset, then the fields.

    A null or empty line never conforms. Repeated lines are loaded once per offset. Other columns of `raw` are not carried,
    so their names cannot clash with fields.
    """
    parsed = raw.select(F.col(offset), F.col(line).alias("_line")).filter(well_quoted(F.col("_line")))
    parsed = computed_once(parsed, {"_f": split_record(F.col("_line"))}).filter(F.size("_f") == len(fields))
    parsed = computed_once(parsed, {"_n": _numbers("_f", fields), "_blank": F.transform("_f", is_blank)})
    sound = reduce(Column.__and__, _sound_fields("_blank", "_n", fields).values())
    typed = []
    for i, f in enumerate(fields):
        kind, number = RULES[f].kind, F.get("_n", F.lit(i))
        value = number if kind == "real" else number.try_cast("bigint" if f == "duration_ms" else "int") if kind == "whole" else stripped(F.get("_f", F.lit(i)))
        typed.append(value.alias(f))
    return parsed.filter(sound).select(F.col(offset), *typed)


def _numbers(values: str, fields: list[str]) -> Column:
    """Every field as a number, whole ones truncated towards zero; null for text fields, for what is no number and for
    whole numbers that are infinite.

    One lambda over the array instead of an expression per field keeps the generated code small.
    """
    whole = F.lit([RULES[f].kind == "whole" for f in fields])
    number = F.lit([RULES[f].kind in ("real", "whole") for f in fields])

    def converted(value: Column, i: Column) -> Column:
        real = F.when(F.get(number, i), to_real(value))
        real = F.when(F.get(whole, i) & (F.abs(real) == float("inf")), None).otherwise(real)
        return F.when(F.get(whole, i), F.when(real < 0, -F.floor(-real)).otherwise(F.floor(real)).cast("double")).otherwise(real)

    return F.transform(values, converted)


def _sound_fields(blanks: str, numbers: str, fields: list[str]) -> dict[str, Column]:
    """field -> whether it meets its rule; never null."""
    return {
        f: ~F.coalesce(F.get(blanks, F.lit(i)), F.lit(True)) if RULES[f].kind == "text" else in_range(F.get(numbers, F.lit(i)), RULES[f])
        for i, f in enumerate(fields)
        if RULES[f].kind != "optional"
    }


def failing_lines(raw: DataFrame, offset: str = "line_id", line: str = "raw_line", fields: list[str] = RECORD_FIELDS) -> DataFrame:
    """The lines that are not loaded, as they are: raw offsets minus loaded offsets. A null offset is never loaded."""
    loaded = strict_load(raw, offset, line, fields).select(offset)
    return raw.select(offset, line).join(loaded, offset, "left_anti")


def diagnose(failing: DataFrame, offset: str = "line_id", line: str = "raw_line", fields: list[str] = RECORD_FIELDS) -> DataFrame:
    """(offset, reasons array<string>) of lines that were not loaded.

    `quoting` or `column_count` stand alone; otherwise one reason, the field's name, per invalid field in field order.
    A null line counts as empty, which is one blank field: column_count.
    """
    split = failing.select(F.col(offset), well_quoted(F.col(line)).alias("_sound"), F.col(line).alias("_line"))
    split = computed_once(split, {"_f": F.when(F.col("_sound"), split_record(F.col("_line")))})
    split = computed_once(split, {"_n": _numbers("_f", fields), "_blank": F.transform("_f", is_blank)})
    invalid = F.array_compact(F.array(*[F.when(~ok, F.lit(f)) for f, ok in _sound_fields("_blank", "_n", fields).items()]))
    return split.select(
        F.col(offset),
        F.when(~F.col("_sound"), F.array(F.lit("quoting")))
        .when(F.size("_f") != len(fields), F.array(F.lit("column_count")))
        .otherwise(invalid)
        .alias("reasons"),
    )


def failure_reasons(raw: DataFrame, offset: str = "line_id", line: str = "raw_line", fields: list[str] = RECORD_FIELDS) -> DataFrame:
    """(offset, reason), one row per reason of every line that cannot be loaded; distinct."""
    found = diagnose(failing_lines(raw, offset, line, fields), offset, line, fields)
    return found.select(offset, F.explode("reasons").alias("reason")).distinct()


def rejected_rows(raw: DataFrame, offset: str = "line_id", line: str = "raw_line") -> DataFrame:
    """The quarantine form of the failing lines: offset, raw_json (the fields by name, nulls kept, or the line), errors joined by
    '; ' in the wording of the quarantine log; `quoting` and `column_count` stand alone."""
    failing = failing_lines(raw, offset, line).select(F.col(offset).alias("_offset"), F.col(line).alias("_line"))
    split = computed_once(failing, {"_sound": well_quoted(F.col("_line"))})
    split = computed_once(split, {"_f": F.when(F.col("_sound"), split_record(F.col("_line")))})
    fields = split.select("*", *[F.get("_f", F.lit(i)).alias(f) for i, f in enumerate(RECORD_FIELDS)])
    whole = F.coalesce(F.size("_f") == len(RECORD_FIELDS), F.lit(False))
    numbers = numbers_of()
    errors = F.when(~F.col("_sound"), F.array(F.lit("quoting"))).when(~whole, F.array(F.lit("column_count"))).otherwise(row_errors())
    named = F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"})
    out = computed_once(fields, numbers).select("_offset", F.when(whole, named).otherwise(F.to_json(F.struct(F.col("_line").alias("line")))).alias("raw_json"), F.array_join(errors, "; ").alias("errors"))
    return out.withColumnRenamed("_offset", offset)
