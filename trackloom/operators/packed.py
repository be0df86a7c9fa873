"""Several values packed in one field: the dialect is chosen per field by minimum description length.

A dialect says which characters delimit, whether quote marks enclose and whether brackets wrap the list. A parse costs the code
lengths of its values, of its delimiters and of its dialect; every field gets its cheapest parse. Code lengths come from the
whole column: all fields are split as far as they can be, the values are counted (a distributed aggregation), and a value's
code is -log2 of its share. Only values that fill at least 1/65,536 of all occurrences get a code word of their own, so the code
book has at most 65,536 entries whatever the size of the table; every other value is spelt out in characters after an escape.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Characters a value is never split at besides letters and digits, quote pairs, wrappers of a list.
INNER = set(" -&'’‐‑   ")
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
WRAPPERS = {"[": "]", "{": "}", "(": ")"}
BOOK_ENTRIES = 65_536
CACHE_ENTRIES = 100_000


@dataclass(frozen=True)
class CodeBook:
    """Bits of known values, bits of the escape and bits of characters."""

    values: dict[str, float]
    escape: float
    chars: dict[str, float]
    other_char: float

    def bits(self, value: str, quoted: bool) -> float:
        known = self.values.get(value)
        folded = self.values.get(value.lower())
        if folded is not None:
            known = min(known if known is not None else math.inf, folded + 4)
        if known is not None:
            return known
        spelt = self.escape + sum(self.chars.get(c, self.other_char) for c in value.lower())
        return spelt - (self.other_char - 8) * sum(c not in self.chars for c in value.lower()) * quoted

    @staticmethod
    def of(counts: dict[str, int], total: int) -> CodeBook:
        total = max(total, 1)
        chars: dict[str, int] = {}
        for value, n in counts.items():
            if not any(splits(c) for c in value):
                for c in value.lower():
                    chars[c] = chars.get(c, 0) + n
        letters = sum(chars.values()) + 64
        unknown = max(total - sum(counts.values()), total / 256)
        return CodeBook(
            {v: -math.log2(n / total) for v, n in counts.items()}, -math.log2(min(1.0, unknown / total)) + 1,
            {c: -math.log2(n / letters) for c, n in chars.items()}, math.log2(letters) + 2,
        )


def splits(char: str) -> bool:
    """Whether a character can delimit values."""
    return not (char.isalnum() or char in INNER or char in QUOTES or char in QUOTES.values() or char in WRAPPERS or char in WRAPPERS.values() or (char.isspace() and char not in "\t\n\r\v\f"))


def parse(text: str, delimiters: frozenset[str], quoting: bool) -> list[tuple[str, bool]]:
    """(value, whether it was enclosed) in order; values that are empty are dropped."""
    found, i, n = [], 0, len(text)
    while i <= n:
        while i < n and text[i].isspace() and text[i] not in delimiters:
            i += 1
        end = _enclosed_end(text, i, delimiters) if quoting and i < n and text[i] in QUOTES else -1
        if end >= 0:
            mark = QUOTES[text[i]]
            value = text[i + 1 : end].replace(mark * 2, mark) if mark == '"' else text[i + 1 : end]
            if value.strip():
                found.append((value, True))
            i = end + 1
            while i < n and text[i] not in delimiters:
                i += 1
        else:
            start = i
            while i < n and text[i] not in delimiters:
                i += 1
            if value := text[start:i].strip():
                found.append((value, False))
        i += 1
    return found


def _enclosed_end(text: str, start: int, delimiters: frozenset[str]) -> int:
    """Where the quote mark opened at start closes: before blanks and a delimiter or the end. -1: nowhere."""
    mark, n = QUOTES[text[start]], len(text)
    i = text.find(mark, start + 1)
    while i >= 0:
        if mark == '"' and text[i + 1 : i + 2] == '"':
            i = text.find(mark, i + 2)
            continue
        j = i + 1
        while j < n and text[j].isspace() and text[j] not in delimiters:
            j += 1
        if j >= n or text[j] in delimiters:
            return i
        i = text.find(mark, i + 1)
    return -1


MOST_DELIMITERS = 10


def dialects(text: str) -> Iterator[tuple[str, frozenset[str], bool, float]]:
    """(text without wrapper, delimiters, quoting, bits of the dialect) of every dialect a field may be written in.

    All combinations of the delimiters in a field, up to MOST_DELIMITERS different ones; of a field with more (a sentence, say, not a
    list) every combination of up to three, and all together.
    """
    inner = text.strip()
    forms = [(inner, 0.0)]
    if len(inner) > 1 and WRAPPERS.get(inner[0]) == inner[-1]:
        forms = [(inner[1:-1], 1.0), (inner, 3.0)]
    for form, wrap_bits in forms:
        marks = sorted({c for c in form if splits(c)})
        sizes = range(len(marks) + 1) if len(marks) <= MOST_DELIMITERS else (0, 1, 2, 3, len(marks))
        sets = [c for r in sizes for c in combinations(marks, r)]
        quotings = (True, False) if any(c in QUOTES for c in form) else (False,)
        for chosen in sets:
            for quoting in quotings:
                yield form, frozenset(chosen), quoting, wrap_bits + 2.0 * len(chosen) + quoting


def widest(text: str) -> list[str]:
    """Split at every possible delimiter, quotes enclosing, wrapper off: the parse that is counted."""
    form = next(iter(dialects(text)))[0]
    return [v for v, _ in parse(form, frozenset(c for c in form if splits(c)), True)]


def cheapest(text: str, book: CodeBook) -> list[str]:
    """The values of a field under its cheapest dialect; of equal ones the first."""
    best, least = [], math.inf
    for form, delimiters, quoting, bits in dialects(text):
        values = parse(form, delimiters, quoting)
        bits += sum(book.bits(v, q) for v, q in values) + 1.0 * max(0, len(values) - 1)
        if bits < least - 1e-9:
            best, least = [v for v, _ in values], bits
    return best


def code_book(df: DataFrame, column: str) -> CodeBook:
    """Value-code lengths of a column of packed fields, from all its rows; at most BOOK_ENTRIES values reach the driver."""

    @F.pandas_udf("array<string>")
    def split_wide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else widest(t))

    distinct = df.select(F.col(column).alias("_t")).filter(F.col("_t").isNotNull()).groupBy("_t").agg(F.count("*").alias("_n"))
    counts = distinct.select("_n", F.explode(split_wide("_t")).alias("_v")).groupBy("_v").agg(F.sum("_n").alias("_n"))
    seen = Observation("packed")
    top = counts.observe(seen, F.sum("_n").alias("total")).orderBy(F.desc("_n"), "_v").limit(BOOK_ENTRIES).collect()
    total = int((seen.get.get("total") if top else 0) or 0)
    least = max(1.0, total / BOOK_ENTRIES)
    return CodeBook.of({r["_v"]: r["_n"] for r in top if r["_n"] >= least}, total)


def unpack(df: DataFrame, column: str, keys: list[str], value: str = "tag", position: str = "tag_pos") -> DataFrame:
    """One row per value: the key columns, the position from 1 and the value.

    Null, empty and blank fields, and fields of delimiters only, give no row. Repeated values and repeated rows are kept. The
    result has only the keys, the position and the value, so other columns of df cannot clash.
    """
    book = df.sparkSession.sparkContext.broadcast(code_book(df, column))

    @F.pandas_udf("array<string>")
    def split_cheapest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for texts in batches:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                if t not in known:
                    known[t] = cheapest(t, book.value)
                out.append(known[t])
            yield pd.Series(out, dtype=object)

    packed: Column = F.posexplode(split_cheapest(F.col(column))).alias("_p", value)
    return df.filter(F.col(column).isNotNull()).select(*keys, packed).select(*keys, (F.col("_p") + 1).cast("int").alias(position), value)
