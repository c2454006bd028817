"""Task heartbeats as a stream: latest beat, time-out, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.operators.skew import carry_forward, row_blocks
from assetlake.streaming.run import prepare_stateful

def latest_beats(beats: DataFrame) -> DataFrame:
    """The latest beat per task, for update mode. Partial aggregates run before the shuffle."""
    rest = [c for c in beats.columns if c not in ("task_id", "ts")]
    order = F.struct("ts", *[c for c in ("event_id",) if c in rest])
    return beats.groupBy("task_id").agg(F.max_by(F.struct("ts", *rest), order).alias("b"), F.count("*").alias("beats")).select(
        "task_id", F.col("b.ts").alias("last_heartbeat"), *[F.col(f"b.{c}").alias(c) for c in rest], "beats")


def stale_events(beats: DataFrame, delay: str = "1 minute", minutes: int = C.STALE_MINUTES) -> DataFrame:
    """FAILED events of tasks without a beat for some minutes of event time, as a stream.

    A task fails where a session of its beats ends: a gap of more than the limit closes it when a later beat comes, or before
    that when the watermark passes the limit, and only once. Sessions of a batch are merged before the shuffle, so a hot task sends a few rows per
    input task. Times count in whole milliseconds. Beats later than the watermark are dropped. The last silent task is reported
    when any later beat moves the watermark past its limit.
    """
    prepare_stateful(beats.sparkSession)
    limit = minutes * 60_000
    thin = beats.select("task_id", F.timestamp_millis(F.unix_millis("ts")).alias("ts")).withWatermark("ts", delay)
    # Sessions that touch are merged; half a millisecond more and none touch that are over the limit apart.
    closed = thin.groupBy("task_id", F.session_window("ts", f"{limit} milliseconds 500 microseconds").alias("s")).agg(F.max("ts").alias("last_heartbeat"))
    return closed.select("task_id", "last_heartbeat", (F.col("last_heartbeat") + F.expr(f"interval {minutes} minutes")).alias("failed_at"),
                         F.lit("FAILED").alias("status"), F.lit(C.STALE_MESSAGE).alias("error_message"))


def stale_events_batch(beats: DataFrame, delay_seconds: int = 60, minutes: int = C.STALE_MINUTES) -> DataFrame:
    """Batch twin: gaps longer than the limit, and last beats the final watermark has passed.

    Beats are thinned to one per task and hour edge: within an hour only neighbouring beats
    are compared, and each hour passes its first beat back to the hour before.
    """
    limit = minutes * 60_000
    b = beats.select("task_id", F.unix_millis("ts").alias("ms")).distinct().withColumn("_h", F.floor(F.col("ms") / 3_600_000))
    firsts = b.groupBy("task_id", "_h").agg(F.min("ms").alias("_first"))
    following = F.lead("_first").over(W.partitionBy("task_id").orderBy("_h"))
    edges = firsts.select("task_id", "_h", following.alias("_later"))
    nxt = F.lead("ms").over(W.partitionBy("task_id", "_h").orderBy("ms"))
    gaps = b.withColumn("_in", nxt).join(edges, ["task_id", "_h"]).withColumn("_next", F.coalesce("_in", "_later"))
    end = beats.select(F.max(F.unix_millis("ts"))).scalar()
    hit = gaps.filter(
        (F.col("_next") - F.col("ms") > limit) | (F.col("_next").isNull() & (F.col("ms") + limit + 1 <= end - delay_seconds * 1000)))
    return hit.select(
        "task_id", F.timestamp_millis("ms").alias("last_heartbeat"), F.timestamp_millis(F.col("ms") + limit).alias("failed_at"),
        F.lit("FAILED").alias("status"), F.lit(C.STALE_MESSAGE).alias("error_message"))


_SESSION = ["task_id", "started", "ended", "beats", "max_progress"]


def progress_sessions(beats: DataFrame, gap: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Sessions of beats per task as a stream: start, end, beats, greatest progress. A session appears when the watermark
    has passed its end; ``open_sessions`` has the others."""
    prepare_stateful(beats.sparkSession)
    return beats.withWatermark("ts", delay).groupBy("task_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("beats"), F.max("progress_pct").alias("max_progress")).select(
        "task_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "beats", "max_progress")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped stream of ``progress_sessions`` still holds, from its state."""
    held = spark.read.format("statestore").load(checkpoint).select("value.*")
    return held.select("task_id", "session_window.start", "session_window.end", "count", "max").toDF(*_SESSION)


def progress_sessions_batch(beats: DataFrame, gap: str = "5 minutes", block_rows: int = 1_000_000) -> DataFrame:
    """The same of a whole table, open sessions too.

    Beats of one time are counted together. A beat that comes more than ``gap`` after the one before opens a session; which session
    the others are in is found in blocks of bounded rows, also within one task.
    """
    times = beats.groupBy("task_id", "ts").agg(F.count("*").alias("_beats"), F.max("progress_pct").alias("_most"))
    length = F.expr(f"interval {gap}")
    blocks = row_blocks(times.filter("ts is not null"), ["task_id"], ["ts"], block_rows=block_rows)
    after = carry_forward(blocks, ["task_id"], "_block", ["ts"], "ts", "_before")
    opens = F.when(F.col("_before").isNull() | (F.col("ts") > F.col("_before") + length), F.col("ts"))
    held = carry_forward(after.withColumn("_opens", opens), ["task_id"], "_block", ["ts"], "_opens", "_open")
    return held.groupBy("task_id", F.coalesce("_opens", "_open").alias("started")).agg(
        (F.max("ts") + length).alias("ended"), F.sum("_beats").alias("beats"), F.max("_most").alias("max_progress")).select(*_SESSION)
