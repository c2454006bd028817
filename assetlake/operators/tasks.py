"""Queries on the task log. The present time is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import dates as D
from assetlake.functions import documents as J
from assetlake.operators.filters import with_status
from assetlake.operators.skew import best_per_key


def _now(as_of: str):
    return F.lit(as_of).cast("timestamp")


def task_detail(log: DataFrame, as_of: str, task_id: str | None = None) -> DataFrame:
    """Tasks with parsed metadata and running time in seconds."""
    rows = log.filter(F.col("task_id") == task_id) if task_id else log
    return rows.withColumn("metadata", J.parse_map(F.col("metadata_json"))).withColumn(
        "running_duration_seconds", D.seconds_between(F.col("started_at"), _now(as_of)))


def active_tasks(log: DataFrame, states: Sequence[str] = C.ACTIVE_STATES) -> DataFrame:
    return with_status(log, states).orderBy(F.desc("started_at"), "task_id")


def stale(log: DataFrame, as_of: str, minutes: int = C.STALE_MINUTES, null_is_start: bool = False):
    """Condition: active and without a heartbeat for some minutes. A task that never sent one
    is not stale, unless its start is to count."""
    beat = F.coalesce("last_heartbeat", "started_at") if null_is_start else F.col("last_heartbeat")
    limit = _now(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return F.coalesce(F.upper("status").isin(*C.ACTIVE_STATES) & (beat < limit), F.lit(False))


def expire_stale(log: DataFrame, as_of: str, minutes: int = C.STALE_MINUTES, null_is_start: bool = False) -> DataFrame:
    """The log with stale tasks marked FAILED."""
    old = stale(log, as_of, minutes, null_is_start)
    df = log
    for c in ("completed_at", "error_message"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp" if c == "completed_at" else "string"))
    return df.withColumn("_stale", old).withColumns({
        "status": F.when(F.col("_stale"), "FAILED").otherwise(F.col("status")),
        "completed_at": F.when(F.col("_stale"), _now(as_of)).otherwise(F.col("completed_at")),
        "error_message": F.when(F.col("_stale"), C.STALE_MESSAGE).otherwise(F.col("error_message")),
    }).drop("_stale")


def heartbeat_states(log: DataFrame, as_of: str) -> DataFrame:
    return log.withColumn("health", D.heartbeat_health(F.col("last_heartbeat"), _now(as_of)))


def tasks_like(log: DataFrame, pattern: str) -> DataFrame:
    """Tasks whose id matches a LIKE pattern (``_`` matches any one character)."""
    return log.filter(F.col("task_id").like(pattern))


def recent(log: DataFrame, n: int = 10, column: str = "started_at", tie: str = "task_id") -> DataFrame:
    return log.orderBy(F.desc(column), tie).limit(n)


def apply_beats(log: DataFrame, beats: DataFrame) -> DataFrame:
    """The task log after heartbeats: the latest beat per task updates progress, message and
    time; a terminal status sets the completion time. Beats of unknown tasks change nothing."""
    cols = ["ts", "progress_pct", "status_message", "metadata_json", "status"]
    b = beats
    for c in cols:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast("string"))
    tie = ["event_id"] if "event_id" in b.columns else []
    order = F.struct("ts", *tie)
    # Metadata and status keep their last given value; the other fields are those of the last beat.
    last = best_per_key(b, ["task_id"], ["ts", *tie], ["ts", "progress_pct", "status_message"], latest=True, extra=[
        F.max_by("metadata_json", F.when(F.col("metadata_json").isNotNull(), order)).alias("metadata_json"),
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"),
        F.max(F.when(F.col("status").isin(*C.TERMINAL_STATES), F.col("ts"))).alias("done"),
    ]).select("task_id", F.col("ts").alias("_ts"), F.col("progress_pct").alias("_p"), F.col("status_message").alias("_m"),
              F.col("metadata_json").alias("_j"), F.col("status").alias("_s"), F.col("done").alias("_d"))
    out = log.join(last, "task_id", "left")
    fresh = {"last_heartbeat": "_ts", "progress_pct": "_p", "status_message": "_m", "metadata_json": "_j", "status": "_s", "completed_at": "_d"}
    for c, new in fresh.items():
        out = out.withColumn(c, F.coalesce(F.col(new), F.col(c)) if c in log.columns else F.col(new))
    return out.drop("_ts", "_p", "_m", "_j", "_s", "_d")
