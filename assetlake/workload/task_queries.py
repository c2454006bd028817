"""Queries on the task log."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators import tasks as T
from assetlake.session import scratch_path
from assetlake.sources import tables as K
from assetlake.sources.writers import insert_missing, upsert
from assetlake.workload.registry import query

c = F.col
NOW = "1998-06-01 00:00:00"


@query("Q1_task_detail", f"""
SELECT task_id, CASE WHEN metadata_json LIKE '{{%' THEN json_extract_string(metadata_json, '$.file') END AS file, epoch(TIMESTAMP '{NOW}') - epoch(started_at) AS running_duration_seconds FROM task_log""")
def task_detail(t):
    return T.task_detail(t.task_log, NOW).select("task_id", c("metadata")["file"].alias("file"), "running_duration_seconds")


@query("Q2_active_tasks", "SELECT task_id, status FROM task_log WHERE status IN ('STARTING', 'RUNNING', 'PAUSED') ORDER BY started_at DESC, task_id")
def active_tasks(t):
    return T.active_tasks(t.task_log).select("task_id", "status")


@query("Q3_stale_tasks", f"""
SELECT task_id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, CASE WHEN stale THEN 'Heartbeat timeout - no update for 5 minutes' END AS error_message
FROM (SELECT *, status IN ('STARTING', 'RUNNING', 'PAUSED') AND last_heartbeat IS NOT NULL AND last_heartbeat < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE AS stale FROM task_log)""")
def stale_tasks(t):
    return T.expire_stale(t.task_log, NOW).select("task_id", "status", "error_message")


@query("Q3_stale_tasks_from_start", f"""
SELECT task_id FROM task_log WHERE status IN ('STARTING', 'RUNNING', 'PAUSED') AND coalesce(last_heartbeat, started_at) < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE""")
def stale_from_start(t):
    return t.task_log.filter(T.stale(t.task_log, NOW, null_is_start=True)).select("task_id")


@query("Q4_heartbeat_health", """
SELECT task_id, CASE WHEN last_heartbeat IS NULL THEN 'unknown' WHEN age < 30 THEN 'healthy' WHEN age < 60 THEN 'warning' ELSE 'critical' END AS health
FROM (SELECT task_id, last_heartbeat, epoch(TIMESTAMP '1998-06-01 00:01:00') - epoch(last_heartbeat) AS age FROM task_log)""")
def heartbeat_health(t):
    return T.heartbeat_states(t.task_log, "1998-06-01 00:01:00").select("task_id", "health")


@query("Q5_tasks_by_prefix", "SELECT task_id, status FROM task_log WHERE task_id LIKE 'TASK_1997%'")
def by_prefix(t):
    return T.tasks_like(t.task_log, "TASK_1997%").select("task_id", "status")


@query("Q6_completion_update", """
WITH log AS (SELECT DISTINCT task_id FROM heartbeats), b AS (SELECT *, CASE status_message WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'RUNNING' END AS st FROM heartbeats)
SELECT log.task_id, arg_max(st, (ts, event_id)) AS status, arg_max(progress_pct, (ts, event_id)) AS progress_pct, strftime(max(ts) FILTER (st IN ('FAILED', 'COMPLETED')), '%Y-%m-%d %H:%M:%S') AS completed_at
FROM log JOIN b USING (task_id) GROUP BY log.task_id""")
def completion_update(t):
    log = t.heartbeats.select("task_id").distinct().withColumns({"status": F.lit("STARTING"), "progress_pct": F.lit(0.0)})
    m = c("status_message")
    beats = t.heartbeats.withColumn("status", F.when(m == "error", "FAILED").when(m == "purchase", "COMPLETED").otherwise("RUNNING"))
    return T.apply_beats(log, beats).select("task_id", "status", "progress_pct", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("Z13_keyed_update", """
SELECT i.asset_id, coalesce(CAST(l.quality + 1000000 AS BIGINT), i.size_bytes) AS value FROM inventory i LEFT JOIN labels l ON l.doc_id = i.asset_id""")
def keyed_update(t):
    base = t.inventory.select("asset_id", c("size_bytes").alias("value"))
    new = t.labels.select(c("doc_id").alias("asset_id"), (c("quality") + 1000000).cast("long").alias("value"))
    return upsert(base, new, ["asset_id"])


@query("Z14_insert_missing", """
SELECT doc_id AS asset_id, CAST(quality AS BIGINT) AS value FROM labels UNION ALL SELECT asset_id, size_bytes FROM inventory WHERE asset_id NOT IN (SELECT doc_id FROM labels)""")
def insert_defaults(t):
    base = t.labels.select(c("doc_id").alias("asset_id"), c("quality").cast("long").alias("value"))
    return insert_missing(base, t.inventory.select("asset_id", c("size_bytes").alias("value")), ["asset_id"])


@query("Z13_update_in_place", """
SELECT i.asset_id, coalesce(CAST(l.quality + 1000000 AS BIGINT), i.size_bytes) AS value FROM inventory i LEFT JOIN labels l ON l.doc_id = i.asset_id""")
def update_in_place(t):
    path = scratch_path(t.spark, "keyed")
    K.write_keyed(t.inventory.select("asset_id", c("size_bytes").alias("value")), path, ["asset_id"], 8)
    K.upsert_keyed(t.spark, path, t.labels.select(c("doc_id").alias("asset_id"), (c("quality") + 1000000).cast("long").alias("value")), ["asset_id"], 8)
    return K.read_keyed(t.spark, path)


@query("Z14_defaults_in_place", """
SELECT doc_id AS asset_id, CAST(quality AS BIGINT) AS value FROM labels UNION ALL SELECT asset_id, size_bytes FROM inventory WHERE asset_id NOT IN (SELECT doc_id FROM labels)""")
def defaults_in_place(t):
    path = scratch_path(t.spark, "keyed")
    K.write_keyed(t.labels.select(c("doc_id").alias("asset_id"), c("quality").cast("long").alias("value")), path, ["asset_id"], 8)
    K.upsert_keyed(t.spark, path, t.inventory.select("asset_id", c("size_bytes").alias("value")), ["asset_id"], 8, replace=False)
    return K.read_keyed(t.spark, path)
