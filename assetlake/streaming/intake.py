"""New files into the inventory, and transfer progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlake.operators.windows import latest_per_key


def start_intake(files: DataFrame, table: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append new files to an inventory table, one folder per batch.

    A path seen again within the watermark is dropped. A batch that runs twice replaces its
    own folder. ``current_inventory`` gives the latest row per path.
    """
    fresh = files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["path"])

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def current_inventory(table: DataFrame) -> DataFrame:
    return latest_per_key(table, ["path"], ["modified", "batch"])


def transfer_progress(log: DataFrame) -> DataFrame:
    """Running totals of a transfer log, for update mode."""
    s = F.col("status")
    return log.groupBy("session").agg(
        F.count("*").alias("processed"), F.count_if(s == "VERIFIED").alias("verified"),
        F.count_if(s.isin("SKIPPED", "SKIPPED_EXISTING")).alias("skipped"), F.count_if(s == "FAILED").alias("failed"),
        F.sum(F.when(s == "VERIFIED", F.col("size_bytes")).otherwise(0)).alias("total_bytes"))
