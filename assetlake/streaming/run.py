"""Starting streams: settings, checkpoints, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_stateful(spark: SparkSession) -> None:
    """Keep stream state in RocksDB, and merge the sessions of a batch before they are shuffled."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def read_table_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A Parquet table as a stream, with the table's own schema."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    # A pattern for one name: the table may be a folder or a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{{{name}}}")


def drain_append(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run an append stream over all input that is there and read back what it wrote, below ``out``."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_updates(stream: DataFrame, name: str) -> DataFrame:
    """Run an update stream over all input. Each batch appends its rows with ``batch_id``;
    take the latest row per key for the final state."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, so a batch that runs again replaces its own rows.
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/run={batch_id}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("run")


def drain_carrying(
    stream: DataFrame, name: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], out: str | None = None,
) -> DataFrame:
    """Run a stream batch by batch over all input, where each batch needs what earlier ones left, and read back its rows.

    ``step`` makes, of a batch and the table that the batch before left (none at first), the rows of the batch and the table to leave.
    Rows lie in one folder per batch and the table in two by turns: a batch that runs again finds what it found and replaces its own.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{out}/left/{(batch_id - 1) % 2}") if batch_id else None
        rows, left = step(batch, before)
        left.write.mode("overwrite").parquet(f"{out}/left/{batch_id % 2}")
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/run={batch_id}")

    stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("run")
