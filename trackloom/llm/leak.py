"""Evaluation texts leaking into training text: multi-pattern search over words with block shift tables.

The patterns are all stretches of `words` consecutive words of the test items. Words are the alphabet and two words a block. A
text is read from a window's last word: the shift table says how far the window can move before its last block can match any
pattern (a block that is in no pattern lets it jump over all of it); where the shift is 0, the bucket of that block lists the
places of the items it ends, and the window is compared with them directly. Items go to the tasks in sets of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items that are searched for in one pass; a larger collection is searched in several passes.
PASS_CHARS = 20_000_000
WORDS = 12
#: Characters between two brackets above which they may not belong together.
LONG_ASIDE = 400

# Characters that print nothing; hyphens; what stands between a divided word's halves; words.
_UNSEEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿‎‏"))
_BRACKET = re.compile(r"[()\[\]]")
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-‐‑¬][^\S\n]*\r?\n\s*(?=[^\W_])")
_SOFT_BREAK = re.compile(r"­[^\S\n]*\r?\n\s*")
_WORD = re.compile(r"[^\W_]+")


def without_asides(text: str, longest: int | None = None) -> str:
    """text with a blank for each interjection in brackets, however deep, up to `longest` characters. Brackets without their
    partner stay; one of the other kind between two partners keeps them apart, as in '(a [b) c]'."""
    stack: list[tuple[str, int]] = []
    asides: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        if m[0] in "([":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] == ("(" if m[0] == ")" else "["):
            start = stack.pop()[1]
            if longest is not None and m.end() - start > longest:
                continue
            while asides and asides[-1][0] > start:
                asides.pop()
            asides.append((start, m.end()))
        else:
            stack.clear()
    out, at = [], 0
    for start, end in asides:
        out += [text[at:start], " "]
        at = end
    return "".join([*out, text[at:]])


def words_of(text: str | None, longest: int | None = None) -> list[str]:
    """The words a reader sees: runs of letters and digits without regard to case, accents written apart or together,
    ligatures, wide forms, invisible characters, line division, and without interjections in round or square brackets."""
    if not text:
        return []
    text = _SOFT_BREAK.sub("", text).translate(_UNSEEN)
    text = _DIVIDED.sub("", without_asides(text, longest))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        text = "".join(c for c in text if not unicodedata.combining(c))
    else:
        text = text.lower()
    return _WORD.findall(text)


def readings(text: str | None) -> list[list[str]]:
    """The words of a text; if brackets enclose more than LONG_ASIDE characters, which may be two stray ones, also with those kept."""
    doubtful = text and len(text) > LONG_ASIDE and without_asides(text) != without_asides(text, LONG_ASIDE)
    return [words_of(text), words_of(text, LONG_ASIDE)] if doubtful else [words_of(text)]


@dataclass(frozen=True)
class Patterns:
    """shifts: block to shift. buckets: block to the (item, end) places where it ends a pattern, by the pattern's first and middle
    word, so that a block that ends many patterns leads to few comparisons. items: their words."""

    shifts: dict[tuple[str, str], int]
    buckets: dict[tuple[str, str], dict[tuple[str, str], list[tuple[int, int]]]]
    items: dict[int, list[str]]
    words: int

    @staticmethod
    def of(items: dict[int, list[str]], words: int = WORDS) -> Patterns:
        shifts: dict[tuple[str, str], int] = {}
        buckets: dict[tuple[str, str], dict[tuple[str, str], list[tuple[int, int]]]] = {}
        for item, own in items.items():
            if len(own) < words:
                continue
            for end in range(1, len(own)):
                block = (own[end - 1], own[end])
                shift = max(0, words - 1 - end)
                shifts[block] = min(shifts.get(block, words - 1), shift)
                if end >= words - 1:
                    heads = (own[end - words + 1], own[end - words // 2])
                    buckets.setdefault(block, {}).setdefault(heads, []).append((item, end))
        return Patterns(shifts, buckets, items, words)

    def found_in(self, text: list[str]) -> set[int]:
        """The items of which `text` holds at least `words` consecutive words."""
        found: set[int] = set()
        m, n, far = self.words, len(text), self.words - 1
        shifts, end = self.shifts, self.words - 1
        while end < n:
            block = (text[end - 1], text[end])
            shift = shifts.get(block, far)
            if shift:
                end += shift
                continue
            for item, at in self.buckets[block].get((text[end - m + 1], text[end - m // 2]), ()):
                if item not in found and self.items[item][at - m + 1 : at + 1] == text[end - m + 1 : end + 1]:
                    found.add(item)
            end += 1
        return found


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, item): documents with the items of which they hold at least `words` consecutive words; distinct.

    Null and empty texts hold nothing; items of fewer words than that cannot leak. Items with one id are one item each: ids
    should be unique. No items or no documents: empty. Other columns are not carried.
    """
    spark = documents.sparkSession
    key_type, item_type = dict(documents.dtypes)[key], dict(items.dtypes)[item]
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    passes = max(1, -(-size // PASS_CHARS))
    schema = f"`{key}` {key_type}, _items array<long>"
    results = []
    for number in range(passes):
        part = items.filter(F.pmod(F.xxhash64(item), F.lit(passes)) == number).select(item, text).collect()
        read = [(r[item], own) for r in part for own in readings(r[text])]
        names = [n for n, _ in read]
        patterns = spark.sparkContext.broadcast(Patterns.of({i: own for i, (_, own) in enumerate(read)}, words))

        def search(batches: Iterator[pd.DataFrame], patterns=patterns) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [sorted(set().union(*map(patterns.value.found_in, readings(t)))) for t in pdf[text]]
                out = pd.DataFrame({key: pdf[key], "_items": found})
                yield out[out["_items"].str.len() > 0]

        hits = documents.select(key, text).mapInPandas(search, schema).select(key, F.explode("_items").alias("_i"))
        table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"_i long, `{item}` {item_type}")
        results.append(hits.join(F.broadcast(table), "_i").select(key, item))  # one row per item of a pass
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.distinct()
