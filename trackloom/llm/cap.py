"""Capping records per dominant contributor.

Global range sort by contributor and descending score; partition counts give every row its exact global position
(trackloom.operators.rangesort); a row's rank in its contributor is its position minus the contributor's first position; ranks
below the cap stay. The sort key ends in a unique column, so a contributor with a third of all rows spans many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.rangesort import range_positions
from trackloom.session import blanks_collapsed

#: Contributors above a cap of c rows among n rows number n / (c + 1) at most. Up to this bound they are broadcast.
BROADCAST_CONTRIBUTORS = 10_000
SALTS = 32


def contributor_key(name: Column) -> Column:
    """A name without regard to letter case and to blanks at its ends or repeated; null for a null or blank name."""
    return F.nullif(F.lower(blanks_collapsed(name)), F.lit(""))


def rows_over_cap(df: DataFrame, contributor: Column, score: Column, key: str, cap: int, total: int | None = None) -> DataFrame:
    """(key, contributor) of the rows that a cap of `cap` rows per contributor removes.

    Rows whose contributor is null are never removed. Higher scores stay; null scores come last; ties go to the smaller key,
    which should be unique and not null (rows of one key are ranked in an order fixed once). A cap of 0 removes every row that
    has a contributor. An empty df gives an empty result. Other columns of df are not carried.
    """
    if cap < 0:
        raise ValueError("cap must not be negative")
    total = df.count() if total is None else total
    keyed = df.select(contributor.alias("contributor"), score.alias("_score"), F.col(key)).filter(F.col("contributor").isNotNull())
    placed = range_positions(keyed, [F.col("contributor").asc(), F.col("_score").desc_nulls_last(), F.col(key).asc()])
    starts = placed.groupBy("contributor").agg(F.min("position").alias("_first"), F.count("*").alias("_rows"))
    over = starts.filter(F.col("_rows") > cap).select("contributor", "_first")
    if total / (cap + 1) <= BROADCAST_CONTRIBUTORS:
        found = placed.join(F.broadcast(over), "contributor")
    else:  # too many to send to every task; every contributor is cut in SALTS parts
        salted = over.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = placed.withColumn("_salt", F.pmod("position", F.lit(SALTS)).cast("int")).join(salted, ["contributor", "_salt"])
    return found.filter(F.col("position") - F.col("_first") >= cap).select(key, "contributor")


def cap_share(df: DataFrame, contributor: Column, score: Column, key: str, per: int) -> DataFrame:
    """rows_over_cap with a cap of one `per`-th of the rows of df, rounded down."""
    total = df.count()
    return rows_over_cap(df, contributor, score, key, total // per, total)
