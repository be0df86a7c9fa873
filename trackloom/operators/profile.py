"""Column profile per load: null shares, distinct counts, ranges, malformed values, and shifts of a load against all others.

First the Parquet footers (trackloom.sources.footers), chunk by chunk: where a row group holds one load, its footer gives the nulls,
and a chunk that is all null or whose dictionary has one entry needs no scan; footer extrema and complete dictionaries prove malformed
values. A load all of whose chunks are settled so is left out of the scan by a filter that drops its row groups by their statistics.
Value counts of the other loads, which distribution shifts need, are in no footer: they come from one scan of all columns, counted
map-side, so what is shuffled grows with distinct values, not rows. One row per load and column and per partition passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.operators.rangesort import range_running_totals
from trackloom.session import checkpointed
from trackloom.sources.footers import chunk_facts


@dataclass(frozen=True)
class Check:
    """What is valid in a column: a numeric range, or a pattern the whole text must match."""

    column: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None

    @property
    def numeric(self) -> bool:
        return self.pattern is None

    def valid(self, text: Column) -> Column:
        """Of a value written as a string. NaN is not valid."""
        if not self.numeric:
            return text.rlike(self.pattern)
        number = text.cast("double")
        return ~F.isnan(number) & number.between(self.low, self.high)


# Valid values of the profiled fields.
TRACK_CHECKS = [
    Check("loudness", -60, 5),
    Check("popularity", 0, 100),
    Check("genre", pattern=r"\A[a-z]+([-&][a-z]+)?\z"),
]


@dataclass(frozen=True)
class Profile:
    """counts: (load, column_name, value, n) of all non-null values. sizes: (load, column_name, rows, nulls)."""

    counts: DataFrame
    sizes: DataFrame
    extrema: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def chunk_decisions(spark: SparkSession, table: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """The facts of every chunk, with one_load (footer nulls and extrema are those of one load) and settled (its value counts follow
    from its footer and dictionary: it is not scanned)."""
    facts = chunk_facts(spark, table.inputFiles(), load, columns, columns)
    one = F.coalesce((F.col("key_low") == F.col("key_high")) & (F.col("key_nulls") == 0) & F.col("nulls").isNotNull(), F.lit(False))
    constant = (F.col("nulls") == F.col("rows")) | (F.size(F.array_distinct("entries")) == 1)
    return facts.withColumn("one_load", one).withColumn("settled", F.col("one_load") & F.coalesce(constant, F.lit(False)))


def settled_loads(told: DataFrame, kind: str) -> list:
    """(load, column_name) rows of the loads all of whose chunks are settled and that no row group of several loads may hold."""
    low, high = F.col("key_low").cast(kind), F.col("key_high").cast(kind)
    single = told.filter("one_load").withColumn("load", low).groupBy("load", "column_name").agg(F.bool_and("settled").alias("settled")).filter("settled").drop("settled")
    mixed = told.filter("NOT one_load").select(F.col("column_name").alias("_c"), low.alias("_low"), high.alias("_high"))
    inside = F.col("_low").isNull() | ((F.col("load") >= F.col("_low")) & (F.col("load") <= F.col("_high")))
    touched = mixed.join(F.broadcast(single), (F.col("column_name") == F.col("_c")) & inside).select("load", "column_name").distinct()  # one row a load and column
    return single.join(touched, ["load", "column_name"], "left_anti").collect()


def profile_counts(spark: SparkSession, path: str, load: str, checks: list[Check]) -> Profile:
    """Reads a Parquet table: footers first, then the chunks whose statistics do not suffice.

    Rows whose load is null form a load of their own. An empty table gives empty counts.
    """
    table = spark.read.parquet(path)
    columns, kinds = [c.column for c in checks], dict(table.dtypes)
    told = checkpointed(chunk_decisions(spark, table, load, columns))
    as_load = F.col("key_low").cast(kinds[load]).alias("load")
    known = settled_loads(told, kinds[load])
    done = {c: [r["load"] for r in known if r["column_name"] == c] for c in columns}
    whole = sorted(set.intersection(*[set(v) for v in done.values()])) if columns else []
    rows = table.select(F.col(load).alias("load"), *columns)
    for value in whole:  # one comparison a load: each drops the row groups that hold nothing else
        rows = rows.filter(F.col("load").isNull() | (F.col("load") != F.lit(value)))
    grouped = rows.groupingSets([["load", c] for c in columns], "load", *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    name = reduce(lambda rest, ic: F.when(F.col(f"_g{ic[0]}") == 0, F.lit(ic[1])).otherwise(rest), enumerate(columns), F.lit(None).cast("string"))
    text = reduce(lambda rest, ic: F.when(F.col(f"_g{ic[0]}") == 0, F.col(ic[1]).cast("string")).otherwise(rest), enumerate(columns), F.lit(None).cast("string"))
    scanned = grouped.select("load", name.alias("column_name"), text.alias("value"), "n")
    for c in columns:
        if done[c]:
            scanned = scanned.filter((F.col("column_name") != c) | F.col("load").isNull() | ~F.col("load").isin(done[c]))
    settled = told.filter(F.col("one_load")).withColumn("load", as_load)
    keep = reduce(Column.__or__, [(F.col("column_name") == c) & F.col("load").isin(v) for c, v in done.items() if v], F.lit(False))
    settled = settled.filter(keep)
    constant = settled.filter(F.col("nulls") < F.col("rows")).select("load", "column_name", F.get(F.array_distinct("entries"), F.lit(0)).alias("value"), (F.col("rows") - F.col("nulls")).alias("n"))
    missing = settled.filter(F.col("nulls") > 0).select("load", "column_name", F.lit(None).cast("string").alias("value"), F.col("nulls").alias("n"))
    every = checkpointed(_union([scanned, constant, missing]).groupBy("load", "column_name", "value").agg(F.sum("n").alias("n")))
    all_counts = every.filter(F.col("value").isNotNull())
    all_sizes = every.groupBy("load", "column_name").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    # Malformed values that footers alone prove: out-of-range extrema, invalid dictionary entries.
    proofs = []
    for check in checks:
        own = told.filter((F.col("column_name") == check.column) & F.col("one_load"))
        bad = F.exists("entries", lambda e: ~check.valid(e))
        if check.numeric:
            bad = F.coalesce(bad, F.lit(False)) | F.coalesce(~check.valid(F.col("low")) | ~check.valid(F.col("high")), F.lit(False))
        proofs.append(own.filter(bad).select(as_load, "column_name"))
    return Profile(all_counts, checkpointed(all_sizes), _union(proofs).distinct())


def profile(spark: SparkSession, path: str, load: str = "load_id", checks: list[Check] = TRACK_CHECKS) -> DataFrame:
    """One row per load and column: rows, nulls, null_share, distinct_values, low, high, malformed, and shift, the distance
    between the load's valid values and those of all other loads (numbers: largest difference of the shares of values at or
    below any one value; text: half the sum of absolute differences of shares).

    null_share_rest and shift are null where there are no other rows, or no valid values, to compare with.
    """
    found = profile_counts(spark, path, load, checks)
    is_valid = reduce(lambda rest, c: F.when(F.col("column_name") == c.column, c.valid(F.col("value"))).otherwise(rest), checks, F.lit(False))
    counts = found.counts.withColumn("valid", F.coalesce(is_valid, F.lit(False)))
    numeric = [c.column for c in checks if c.numeric]
    number = F.when(F.col("column_name").isin(numeric), F.col("value").cast("double"))
    per_load = counts.groupBy("load", "column_name").agg(
        F.count("*").alias("distinct_values"),
        F.coalesce(F.min(number).cast("string"), F.min("value")).alias("low"),
        F.coalesce(F.max(number).cast("string"), F.max("value")).alias("high"),
        F.sum(F.when(~F.col("valid"), F.col("n")).otherwise(0)).alias("malformed"),
    )
    whole = found.sizes.groupBy("column_name").agg(F.sum("rows").alias("_rows"), F.sum("nulls").alias("_nulls"))
    sizes = found.sizes.join(F.broadcast(whole), "column_name")  # one row per column
    sizes = sizes.withColumn("null_share", F.col("nulls") / F.col("rows")).withColumn(
        "null_share_rest", F.when(F.col("_rows") > F.col("rows"), (F.col("_nulls") - F.col("nulls")) / (F.col("_rows") - F.col("rows")))
    )
    valid = counts.filter("valid")
    shifts = _numeric_shifts(valid.filter(F.col("column_name").isin(numeric))).unionByName(_text_shifts(valid.filter(~F.col("column_name").isin(numeric))))
    out = _join_load(_join_load(sizes, per_load), shifts)
    proof = found.extrema.withColumn("proved", F.lit(True))
    return _join_load(out, proof).select(
        F.col("load").alias(load), "column_name", "rows", "nulls", "null_share", "null_share_rest",
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "low", "high",
        F.coalesce("malformed", F.lit(0)).alias("malformed"), F.coalesce("proved", F.lit(False)).alias("malformed_by_footer"), "shift",
    )


def _join_load(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on load, null loads matching, and column_name."""
    right = right.withColumnsRenamed({"load": "_load", "column_name": "_column"})
    return left.join(right, F.col("load").eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column")), "left").drop("_load", "_column")


def _text_shifts(valid: DataFrame) -> DataFrame:
    """Half the sum of |share in the load - share in the rest|. Values that the load lacks add what the others leave of 1."""
    own = valid.withColumn("_own", F.sum("n").over(Window.partitionBy("load", "column_name")))
    every = valid.groupBy("column_name", "value").agg(F.sum("n").alias("_n"))
    total = valid.groupBy("column_name").agg(F.sum("n").alias("_all"))
    both = own.join(every, ["column_name", "value"]).join(F.broadcast(total), "column_name")
    p, q = F.col("n") / F.col("_own"), (F.col("_n") - F.col("n")) / (F.col("_all") - F.col("_own"))
    sums = both.filter(F.col("_all") > F.col("_own")).groupBy("load", "column_name").agg(F.sum(F.abs(p - q)).alias("_d"), F.sum(q).alias("_q"))
    return sums.select("load", "column_name", ((F.col("_d") + F.greatest(F.lit(0.0), 1 - F.col("_q"))) / 2).alias("shift"))


def _numeric_shifts(valid: DataFrame) -> DataFrame:
    """Largest difference of the cumulative shares of a load and of the rest.

    Between two values of a load its own share is constant and that of the rest only grows, so it is enough to look at each
    value of the load and just below it. Cumulative counts are running totals over global range sorts, so neither a load nor a
    stretch of values with many rows is gathered in one task.
    """
    own = valid.select("load", "column_name", F.col("value").cast("double").alias("v"), "n").groupBy("load", "column_name", "v").agg(F.sum("n").alias("n"))
    every = own.groupBy("column_name", "v").agg(F.sum("n").alias("_n"))
    mine = range_running_totals(own, [F.col("column_name"), F.col("load"), F.col("v")], "n")
    first = mine.groupBy("load", "column_name").agg(F.min("before").alias("_first"), F.sum("n").alias("total"))
    mine = _join_load(mine, first).withColumn("cum", F.col("before") - F.col("_first") + F.col("n")).drop("before", "_first")
    all_of = range_running_totals(every, [F.col("column_name"), F.col("v")], "_n", "_before")
    totals = all_of.groupBy("column_name").agg(F.min("_before").alias("_start"), F.sum("_n").alias("_total"))
    both = mine.join(all_of, ["column_name", "v"]).join(F.broadcast(totals), "column_name").filter(F.col("_total") > F.col("total"))  # one row a column
    both = both.withColumn("_cum", F.col("_before") - F.col("_start") + F.col("_n"))
    rest = F.col("_total") - F.col("total")
    at = F.abs(F.col("cum") / F.col("total") - (F.col("_cum") - F.col("cum")) / rest)
    below = F.abs((F.col("cum") - F.col("n")) / F.col("total") - (F.col("_cum") - F.col("_n") - F.col("cum") + F.col("n")) / rest)
    # Past the load's last value its share is 1 and the rest goes to 1: nothing larger there.
    return both.groupBy("load", "column_name").agg(F.max(F.greatest(at, below)).alias("shift"))


def findings(profiled: DataFrame, load: str = "load_id", checks: list[Check] = TRACK_CHECKS, nulls_over: float = 0.08, shift_over: float = 0.25) -> DataFrame:
    """(load, column_name, finding) of the loads that stand out: nulls, range or pattern, distribution."""
    numeric = F.col("column_name").isin([c.column for c in checks if c.numeric])
    wrong = F.array_compact(F.array(
        F.when(F.col("null_share") > F.col("null_share_rest") + nulls_over, F.lit("nulls")),
        F.when((F.col("malformed") > 0) | F.col("malformed_by_footer"), F.when(numeric, F.lit("range")).otherwise(F.lit("pattern"))),
        F.when(F.col("shift") > shift_over, F.lit("distribution")),
    ))
    return profiled.select(load, "column_name", F.explode(wrong).alias("finding"))
