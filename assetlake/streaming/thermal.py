"""Sensor readings as a stream: pause and resume, rolling history, windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.operators import windows as W
from assetlake.streaming.run import drain_carrying


def thermal_events_stream(
    readings: DataFrame, pause: float = C.PAUSE_CELSIUS, resume: float = C.RESUME_CELSIUS, out: str | None = None, block_rows: int = 1_000_000,
) -> DataFrame:
    """Pause and resume events of all readings that are there, each with its ``batch_id``.

    Batches pass on the last signal of each drive. Within a batch, readings of one drive are taken in time order
    by the same scan as in ``windows.thermal_events``, so a hot drive has many tasks. A batch of no signals passes the table on.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        return W.thermal_events(batch, pause, resume, before, block_rows), W.last_signals(W.signals(batch, pause, resume), before)

    return drain_carrying(readings, "thermal", step, out)


def history_stream(readings: DataFrame, n: int = C.HISTORY_LENGTH, out: str | None = None) -> DataFrame:
    """The last ``n`` readings per drive, summarised after each batch for the drives that it has.

    Batches pass on the table of the readings kept: at most ``n`` per drive. A hot drive is cut down in shares first.
    """

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = W.last_n_salted(batch.select("drive", "ts", "event_id", "temperature"), "drive", ["ts", "event_id"], n)
        kept = new if before is None else W.last_n(new.unionByName(before), "drive", ["ts", "event_id"], n)
        touched = kept.join(new.select("drive").distinct(), "drive", "left_semi")
        t = F.col("temperature")
        return touched.groupBy("drive").agg(
            F.count("*").alias("readings"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.min(t).alias("min_temperature"),
            F.max(t).alias("max_temperature")), kept

    return drain_carrying(readings, "history", step, out)


def windowed_statistics(readings: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Least, greatest and mean temperature per drive and window, tumbling or sliding."""
    src = readings.withWatermark("ts", delay) if readings.isStreaming else readings
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    t = F.col("temperature")
    return src.groupBy("drive", w.alias("w")).agg(
        F.count("*").alias("readings"), F.min(t).alias("min_temperature"), F.max(t).alias("max_temperature"), F.avg(t).alias("avg_temperature")
    ).select("drive", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "readings", "min_temperature",
             "max_temperature", F.round("avg_temperature", 2).alias("avg_temperature"))
