"""Streams drained over the event and transfer tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import windows as W
from assetlake.session import scratch_path
from assetlake.streaming import heartbeats as B
from assetlake.streaming import intake as I
from assetlake.streaming import thermal as H
from assetlake.streaming.run import drain_append, drain_updates, read_table_stream
from assetlake.workload.registry import query

c = F.col
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(t):
    return read_table_stream(t.spark, f"{t.folder.rstrip('/')}/events.parquet")


def _readings(t):
    return _events(t).select("event_id", c("user_id").alias("drive"), c("ts").cast("timestamp").alias("ts"), c("value").alias("temperature"))


def _beats(t):
    return _events(t).select(
        "event_id", F.format_string("TASK_20240101_%04d", "user_id").alias("task_id"), c("ts").cast("timestamp").alias("ts"), c("value").alias("progress_pct"),
        c("event_type").alias("status_message"))


_LATEST = """SELECT task_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS beats FROM heartbeats GROUP BY task_id"""


@query("R1_latest_beat_stream", _LATEST)
def latest_stream(t):
    out = drain_updates(B.latest_beats(_beats(t)), "latest-beats")
    return W.latest_per_key(out, ["task_id"], ["batch_id"]).select("task_id", "event_id", "beats")


@query("R1_latest_beat_batch", _LATEST)
def latest_batch(t):
    return B.latest_beats(t.heartbeats).select("task_id", "event_id", "beats")


# The final watermark is one minute behind the latest event, in whole milliseconds.
_STALE = """WITH b AS (SELECT DISTINCT task_id, epoch_us(ts) // 1000 AS ms FROM heartbeats), n AS (SELECT *, lead(ms) OVER (PARTITION BY task_id ORDER BY ms) AS nxt FROM b)
SELECT task_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS last_heartbeat, 'FAILED' AS status FROM n
WHERE nxt - ms > 300000 OR (nxt IS NULL AND ms + 300001 <= (SELECT max(ms) FROM b) - 60000)"""


@query("R2_stale_event_stream", _STALE)
def stale_stream(t):
    out = drain_append(B.stale_events(_beats(t)), "stale")
    return out.select("task_id", F.date_format("last_heartbeat", _STAMP).alias("last_heartbeat"), "status")


@query("R2_stale_event_batch", _STALE)
def stale_batch(t):
    return B.stale_events_batch(t.heartbeats).select("task_id", F.date_format("last_heartbeat", _STAMP).alias("last_heartbeat"), "status")


_THERMAL = """WITH s AS (SELECT *, CASE WHEN temperature >= 55 THEN 'THERMAL_PAUSE' WHEN temperature <= 45 THEN 'THERMAL_RESUME' END AS event FROM readings),
p AS (SELECT *, lag(event, 1, 'THERMAL_RESUME') OVER (PARTITION BY drive ORDER BY ts, event_id) AS prev FROM s WHERE event IS NOT NULL)
SELECT drive, event_id, event, temperature FROM p WHERE event <> prev"""


@query("R3_thermal_event_stream", _THERMAL)
def thermal_stream(t):
    return H.thermal_events_stream(_readings(t)).select("drive", "event_id", "event", "temperature")


@query("R3_thermal_event_batch", _THERMAL)
def thermal_batch(t):
    return W.thermal_events(t.readings).select("drive", "event_id", "event", "temperature")


@query("A20_pause_and_resume_counts", f"""
WITH e AS ({_THERMAL}) SELECT r.drive, count(*) FILTER (e.event = 'THERMAL_PAUSE') AS pauses, count(*) FILTER (e.event = 'THERMAL_RESUME') AS resumes
FROM (SELECT DISTINCT drive FROM readings) r LEFT JOIN e ON e.drive = r.drive GROUP BY r.drive""")
def pause_counts(t):
    from assetlake.operators.aggregates import temperature_statistics

    return temperature_statistics(t.readings, W.thermal_events(t.readings)).select("drive", "pauses", "resumes")


_HISTORY = """SELECT drive, count(*) AS readings, min(temperature) AS min_temperature, max(temperature) AS max_temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY drive ORDER BY ts DESC, event_id DESC) AS rn FROM {0}) WHERE rn <= {1} GROUP BY drive"""


def _history(readings, n):
    out = H.history_stream(readings, n)
    return W.latest_per_key(out, ["drive"], ["batch_id"]).select("drive", "readings", "min_temperature", "max_temperature")


@query("R4_history_stream", _HISTORY.format("readings", 20))
def history_stream(t):
    return _history(_readings(t), 20)


@query("R4_full_history_stream", _HISTORY.format("(SELECT * REPLACE (drive % 3 AS drive) FROM readings)", 1000))
def full_history_stream(t):
    """Three drives, which have more readings than are kept."""
    return _history(_readings(t).withColumn("drive", c("drive") % 3), 1000)


@query("R5_windowed_statistics_stream", """
SELECT drive, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS readings, min(temperature) AS min_temperature, max(temperature) AS max_temperature FROM readings GROUP BY ALL""")
def windowed_stream(t):
    """Also the windows that are still open at the end, as they stand then."""
    out = drain_updates(H.windowed_statistics(_readings(t), "1 day"), "windows")
    out = W.latest_per_key(out, ["drive", "window_start"], ["batch_id"])
    return out.select("drive", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "readings", "min_temperature", "max_temperature")


@query("R5_windowed_statistics_sliding", """
SELECT drive, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS readings, max(temperature) AS max_temperature
FROM (SELECT drive, temperature, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM readings) GROUP BY ALL""")
def windowed_sliding(t):
    out = H.windowed_statistics(t.readings, "2 hours", "1 hour")
    return out.select("drive", F.date_format("window_start", _STAMP).alias("window_start"), "readings", "max_temperature")


_SESSIONS = """WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM heartbeats WINDOW w AS (PARTITION BY task_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n), g AS (SELECT task_id, k, min(ts) AS a, max(ts) AS z, count(*) AS beats, max(progress_pct) AS max_progress FROM s GROUP BY task_id, k)
SELECT task_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, beats, max_progress FROM g"""


@query("R6_progress_session_stream", _SESSIONS)
def session_stream(t):
    """Also the sessions that are still open at the end, as they stand then."""
    path = scratch_path(t.spark, "sessions")
    closed = drain_append(B.progress_sessions(_beats(t), "2 hours"), "sessions", path)
    out = closed.unionByName(B.open_sessions(t.spark, f"{path}/checkpoint"))
    return out.select("task_id", F.date_format("started", _STAMP).alias("started"), "beats", "max_progress")


@query("R6_progress_session_batch", _SESSIONS)
def session_batch(t):
    out = B.progress_sessions_batch(t.heartbeats, "2 hours")
    return out.select("task_id", F.date_format("started", _STAMP).alias("started"), "beats", "max_progress")


_PROGRESS = """SELECT session, count(*) AS processed, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status LIKE 'SKIPPED%') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
CAST(coalesce(sum(size_bytes) FILTER (status = 'VERIFIED'), 0) AS BIGINT) AS total_bytes FROM transfers GROUP BY session"""


@query("R8_transfer_progress_stream", _PROGRESS)
def progress_stream(t):
    raw = read_table_stream(t.spark, f"{t.folder.rstrip('/')}/lineitem.parquet")
    n = c("l_linenumber") % 3
    log = raw.select(c("l_returnflag").alias("session"), (c("l_quantity") * 1000).cast("long").alias("size_bytes"),
                     F.when(c("l_linestatus") == "F", "VERIFIED").when(n == 0, "SKIPPED").when(n == 1, "SKIPPED_EXISTING").otherwise("FAILED").alias("status"))
    out = drain_updates(I.transfer_progress(log), "progress")
    return W.latest_per_key(out, ["session"], ["batch_id"]).drop("batch_id")


@query("R8_transfer_progress_batch", _PROGRESS)
def progress_batch(t):
    return I.transfer_progress(t.transfers)
