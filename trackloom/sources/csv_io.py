"""CSV in and out, and typed Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.schema import RAW_SCHEMA


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as strings by the header, with row_num from 1 in file order.

    Quoted fields may hold line breaks. Row numbers are exact without a single-task window: each partition numbers its own
    rows, and the partitions' sizes (one number each) are added up.
    """
    rows = spark.read.csv(path, header=True, schema=RAW_SCHEMA, multiLine=True, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    placed = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_start")  # a row per partition
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").select((F.col("_start") + local + 1).alias("row_num"), *rows.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV folder with headers, fields in the order of df. Quotes inside fields are doubled."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Drops and writes a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
