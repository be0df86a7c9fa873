"""Exact global positions and running totals without a single-task window.

A window without partition keys runs in one task. Here rows are range-partitioned and sorted, each row learns its place in its
own partition, the partitions' totals (one number per partition) are summed on the driver, and a row's global value is its
partition's start plus its local value. The sort key should end in a unique column: then a value that fills a third of the
table is cut over many partitions like any other stretch of rows.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import checkpointed, partitions

LOCAL_BITS = (1 << 33) - 1


def range_positions(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """df with a bigint column of each row's place, from 0, in the global order.

    Ties in `order` get different places in an order that is fixed once the result exists (it is checkpointed, as a range
    partitioning may cut elsewhere when it is run again). An empty df gives an empty result.
    """
    count = partitions(df.sparkSession)
    local = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_BITS))})
    )
    local = checkpointed(local)
    sizes = {r[0]: r[1] for r in local.groupBy("_part").count().collect()}
    return _shifted(local, sizes, position, "_local")


def range_running_totals(df: DataFrame, order: list[Column], weight: str, total: str = "before") -> DataFrame:
    """df with a bigint column of the sum of `weight` over all rows before each one in the global order.

    A null weight counts as 0. Result is checkpointed, as in range_positions.
    """
    count = partitions(df.sparkSession)
    ordered = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("_local", T.LongType())])

    def running(batches):
        before = 0
        for pdf in batches:
            weights = pdf[weight].fillna(0).astype("int64")
            ends = weights.cumsum() + before
            pdf["_local"] = ends - weights
            before = int(ends.iloc[-1]) if len(ends) else before
            yield pdf

    local = checkpointed(ordered.mapInPandas(running, schema))
    sums = {r[0]: int(r[1] or 0) for r in local.groupBy("_part").agg(F.sum(weight)).collect()}
    return _shifted(local, sums, total, "_local")


def _shifted(local: DataFrame, sizes: dict[int, int], name: str, column: str) -> DataFrame:
    """Adds to each row the total of all partitions before its own; `sizes` has one entry per partition."""
    parts = sorted(sizes)
    starts = dict(zip(parts, accumulate([0, *[sizes[p] for p in parts]])))
    if not parts:
        return local.withColumn(name, F.col(column)).drop("_part", "_local")
    table = local.sparkSession.createDataFrame(pd.DataFrame({"_part": list(starts), "_start": list(starts.values())}), "_part int, _start long")
    return local.join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + F.col(column)).drop("_part", "_local", "_start")
