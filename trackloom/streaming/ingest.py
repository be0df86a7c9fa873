"""Strict loading of raw lines as they arrive: the row-wise part of the batch operator, with its own quarantine stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.operators.strict_load import diagnose, strict_load


def start_load(lines: DataFrame, loaded_path: str, rejected_path: str, checkpoint: str, offset: str = "line_id", line: str = "raw_line") -> StreamingQuery:
    """Writes each micro-batch's typed rows and its failing lines with reasons. lines: a stream with offset and line.

    A batch that is run again overwrites its own folders, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        strict_load(batch, offset, line).write.mode("overwrite").parquet(f"{loaded_path}/batch={number}")
        reasons = diagnose(batch, offset, line).filter(F.size("reasons") > 0)
        reasons.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
