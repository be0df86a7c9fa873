"""Session helpers that work alike on a laptop and on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only where none is set and all tasks run in one process
    (tests). On a cluster a folder of one machine would be read by others: without a named one this raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="trackloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: its lineage is cut and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The number of partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name near the wanted one that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once per row, however often later expressions use them.

    The optimizer copies a projected expression into every filter above it; it does not copy through a generator, so the
    columns go through one that gives exactly one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def blanks_collapsed(column):
    """Blanks of any kind, no-break spaces among them, become one space; none at the ends."""
    return F.trim(F.regexp_replace(column, BLANKS, " "))


# Fixed value: every character that counts as a blank, as a Java regular expression.
BLANKS = r"[\s\u0085   -​    　﻿]+"
