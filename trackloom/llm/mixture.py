"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule w(t) over training time t in [0, 1], piecewise linear, scaled so that its integral is the target
share. Its cumulative token demand after time t is D(t) = size of all documents x integral of w from 0 to t, a piecewise quadratic
that is inverted exactly. A source's documents are laid end to end in a pseudo-random order (running totals of tokens from a global
range sort, so no source is gathered in one task); the copy of a document that begins at token c is wanted at the time t with
D(t) = c. Range-sorting all copies by that time gives their training positions. A source is passed through max_repeats times at
most: it is exhausted at the time t with D(t) = max_repeats x its size, and one that is exhausted before the end cannot reach its
share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.rangesort import range_positions, range_running_totals
from trackloom.session import checkpointed

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Up to so many sources the plan is broadcast; beyond, it is joined by source, salted.
BROADCAST_SOURCES = 100_000
SALTS = 32

# Fixed value: how this public vocabulary divides a text before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Schedule = list[tuple[float, float]]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """A function from a text to its number of tokens. path: ranks (.tiktoken) or a tokenizer file (.json)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


def token_count(text: Column, tokenizer_file: str = TOKENIZER_FILE) -> Column:
    """Tokens of a text under a public tokenizer; 0 for null and empty texts. Special tokens in a text are ordinary text."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _tokenizer(tokenizer_file)
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def source_sizes(documents: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """(source, size): tokens per source; null is a source of its own."""
    return documents.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("size"))


def schedule_segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(start, demand before it, weight at its start, slope) per stretch of a piecewise linear schedule, scaled to integral 1.

    schedule: (time, weight) knots, times rising from 0 to 1, weights not negative and not all 0.
    """
    times, weights = [t for t, _ in schedule], [w for _, w in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])) or min(weights) < 0 or max(weights) == 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and weights that are not negative and not all 0")
    areas = [(b - a) * (v + w) / 2 for a, b, v, w in zip(times, times[1:], weights, weights[1:])]
    whole, out, done = sum(areas), [], 0.0
    for i, area in enumerate(areas):
        out.append((times[i], done, weights[i] / whole, (weights[i + 1] - weights[i]) / (times[i + 1] - times[i]) / whole))
        done += area / whole
    return out


EVEN: Schedule = [(0.0, 1.0), (1.0, 1.0)]


def with_schedules(targets: DataFrame, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """targets with `segments` of each source's schedule; sources without one keep an even weight."""
    kind = "array<struct<start:double,before:double,weight:double,slope:double>>"
    rows = [(s, schedule_segments(own)) for s, own in (schedules or {}).items()]
    table = targets.sparkSession.createDataFrame(rows, f"source string, segments {kind}")
    even = F.lit(None).cast(kind)
    even = F.coalesce(even, F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("start", "before", "weight", "slope"), s)]) for s in schedule_segments(EVEN)]))
    return targets.join(F.broadcast(table), "source", "left").withColumn("segments", F.coalesce("segments", even))  # one row per schedule given


def wanted_time(share: Column, segments: Column) -> Column:
    """The time at which the cumulative demand reaches `share` of the whole: the schedule's integral, inverted in its stretch."""
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= share) & ((x["weight"] > 0) | (x["slope"] > 0) | (x["before"] == share))), -1)
    rest = share - s["before"]
    root = F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * s["slope"] * rest, F.lit(0.0)))
    bottom = s["weight"] + root
    return F.when(rest <= 0, s["start"]).otherwise(s["start"] + 2 * rest / bottom)


def plan_shares(sizes: DataFrame, targets: DataFrame, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """Per listed source: size, demand = target_share x size of all documents, supply = max_repeats x size, segments of its
    schedule, and exhausted_at: when its documents are used up, or null if they last to the end. Sources that are missing have
    size 0; documents of sources that are not listed count in the size of all documents only.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    plan = with_schedules(targets, schedules).join(sizes, "source", "left").crossJoin(F.broadcast(total))  # total: one row
    plan = plan.withColumn("size", F.coalesce("size", F.lit(0)))
    plan = plan.withColumns({"demand": F.col("target_share") * F.col("_total"), "supply": F.col("max_repeats") * F.col("size")})
    short = F.col("demand") > F.col("supply")
    used_up = F.when(short, wanted_time(F.col("supply") / F.col("demand"), F.col("segments")))
    return plan.withColumn("exhausted_at", used_up).drop("_total")


def counted_documents(documents: DataFrame, text: str = "text", tokenizer_file: str = TOKENIZER_FILE, *kept: str) -> DataFrame:
    """(kept..., source, tokens), written to the checkpoint folder: texts are tokenised once."""
    return checkpointed(documents.select(*kept, "source", token_count(F.col(text), tokenizer_file).alias("tokens")))


def unreachable_sources(documents: DataFrame, targets: DataFrame, text: str = "text", schedules: dict[str, Schedule] | None = None,
                        tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(source) of the targets that the mixture's plan exhausts before the end of training."""
    counted = documents.select("source", token_count(F.col(text), tokenizer_file).alias("tokens"))
    sizes = checkpointed(source_sizes(counted))  # used twice; the texts are tokenised once
    return plan_shares(sizes, targets, schedules).filter(F.col("exhausted_at").isNotNull()).select("source").distinct()


def _joined(placed: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """placed with its source's plan. Beyond BROADCAST_SOURCES by a shuffle, with every source cut in SALTS parts."""
    if sources <= BROADCAST_SOURCES:
        return placed.join(F.broadcast(plan), "source")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return placed.withColumn("_salt", F.pmod(F.xxhash64("before"), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", schedules: dict[str, Schedule] | None = None,
            tokenizer_file: str = TOKENIZER_FILE, seed: int = 17) -> DataFrame:
    """(key, source, repeat, tokens, time, position): the chosen copies in training order; position from 0.

    schedules: per source, (time, weight) knots of how its weight changes over training; even for the others. A source that
    cannot reach its demand is used max_repeats times in full. Documents of no tokens, of unlisted and of null sources are not
    chosen. Ties in time are ordered by source, repeat and key. Empty documents give an empty result.
    """
    counted = counted_documents(documents, text, tokenizer_file, key)
    plan = plan_shares(source_sizes(counted), targets, schedules)
    placed = range_running_totals(counted.filter("tokens > 0"), [F.col("source"), F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "tokens")
    first = placed.groupBy("source").agg(F.min("before").alias("_first"))
    plan = checkpointed(plan.join(first, "source").withColumn("_wanted", F.least("demand", F.col("supply").cast("double"))))
    copies = _joined(placed, plan.select("source", "size", "demand", "max_repeats", "segments", "_first", "_wanted"), plan.count())
    copies = copies.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(F.col("max_repeats") - 1, F.lit(0)))))
    copies = copies.withColumn("_at", F.col("repeat") * F.col("size") + F.col("before") - F.col("_first"))
    copies = copies.filter((F.col("_at") < F.col("_wanted")) & (F.col("max_repeats") > 0))
    timed = copies.withColumn("time", wanted_time(F.col("_at") / F.col("demand"), F.col("segments")))
    timed = timed.select(key, "source", "repeat", "tokens", "time")
    return range_positions(timed, [F.col("time"), F.col("source"), F.col("repeat"), F.col(key)])


def reached_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, copies, tokens, actual_share) of a mixture; sources of which nothing is chosen have 0."""
    own = chosen.groupBy("source").agg(F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    total = own.agg(F.sum("tokens").alias("_total"))
    joined = targets.select("source", "target_share").join(own, "source", "left").crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return joined.select("source", "target_share", F.coalesce("copies", F.lit(0)).alias("copies"), tokens.alias("tokens"), F.coalesce(tokens / F.col("_total"), F.lit(0.0)).alias("actual_share"))
