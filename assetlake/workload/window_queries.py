"""Queries for ordered logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import names as N
from assetlake.operators import aggregates as A
from assetlake.operators import windows as W
from assetlake.operators.joins import raw_jpg_pairs
from assetlake.plans import rename as R
from assetlake.workload.registry import query

c = F.col


@query("W1_first_per_group", """
SELECT source, path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_bytes DESC, path) AS rn FROM inventory) WHERE rn = 1""")
def first_per_group(t):
    return W.first_per_key(t.inventory.select("source", "path", "size_bytes"), ["source"], [-c("size_bytes"), "path"])


_PHOTOS = """photos AS (SELECT path, folder, camera_short AS camera, extension, coalesce(taken_ts, modified_ts) AS ts, CASE WHEN date_taken <> '' THEN date_taken ELSE modified END AS sort_text
FROM inventory WHERE file_type = 'IMAGE')"""


def photos(t):
    taken = D.first_parsed(c("date_taken"), c("modified"))
    return t.inventory.filter("file_type = 'IMAGE'").select(
        "path", "folder", N.camera_short(N.full_camera(c("camera_make"), c("camera_model"))).alias("camera"), F.date_format(taken, "yyyy-MM-dd").alias("day"),
        D.first_present(c("date_taken"), c("modified")).alias("sort_text"))


@query("W2_sequence_per_date", f"WITH {_PHOTOS} SELECT path, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY sort_text, path) AS seq FROM photos")
def per_date(t):
    return W.sequence(photos(t), ["sort_text", "path"], ["day"]).select("path", "seq")


@query("W3_sequence_per_camera", f"WITH {_PHOTOS} SELECT path, row_number() OVER (PARTITION BY camera ORDER BY sort_text, path) AS seq FROM photos")
def per_camera(t):
    return W.sequence(photos(t), ["sort_text", "path"], ["camera"]).select("path", "seq")


@query("W3_sequence_per_folder", f"WITH {_PHOTOS} SELECT path, row_number() OVER (PARTITION BY folder ORDER BY sort_text, path) AS seq FROM photos")
def per_folder(t):
    return W.sequence(photos(t), ["sort_text", "path"], ["folder"]).select("path", "seq")


@query("W3_sequence_never_reset", f"WITH {_PHOTOS} SELECT path, row_number() OVER (ORDER BY sort_text, path) AS seq FROM photos")
def never_reset(t):
    return W.sequence(photos(t), ["sort_text", "path"]).select("path", "seq")


@query("W4_sequence_shared_by_pairs", """
SELECT path, dense_rank() OVER (ORDER BY lead_path) AS seq FROM (SELECT path, CASE WHEN count(*) OVER w > 1 THEN min(path) OVER w ELSE path END AS lead_path
FROM inventory WHERE file_type = 'IMAGE' WINDOW w AS (PARTITION BY folder, stem))""")
def shared_by_pairs(t):
    files = t.inventory.filter("file_type = 'IMAGE'").select("path")
    pairs = raw_jpg_pairs(files).select("path", "pair_base")
    based = files.join(pairs, "path", "left").withColumn("pair_base", F.coalesce("pair_base", "path"))
    return W.pair_sequence(based).select("path", "seq")


@query("W5_case_folded_conflicts", """
SELECT path, row_number() OVER (PARTITION BY lower(filename) ORDER BY size_bytes, path) > 1 AS conflict FROM inventory""")
def conflicts(t):
    return W.flag_conflicts(t.inventory.select("path", "filename", "size_bytes"), F.lower("filename"), ["size_bytes", "path"]).select("path", "conflict")


@query("W6_name_conflicts", """
WITH plan AS (SELECT path AS source, '/target/' || filename AS destination, filename AS new_name, asset_id AS seq FROM inventory), held AS (SELECT '/target/' || i.filename AS path FROM labels l JOIN inventory i ON i.asset_id = l.doc_id)
SELECT source, CASE WHEN row_number() OVER (PARTITION BY new_name ORDER BY seq, source) > 1 THEN 'duplicate_name' WHEN destination IN (SELECT path FROM held) THEN 'file_exists' END AS conflict FROM plan""")
def name_conflicts(t):
    plan = t.inventory.select(c("path").alias("source"), F.concat(F.lit("/target/"), "filename").alias("destination"), c("filename").alias("new_name"),
                              c("asset_id").alias("seq"), F.lit(True).alias("renamed"))
    held = t.labels.select(c("doc_id").alias("asset_id")).join(t.inventory.select("asset_id", "filename"), "asset_id").select(F.concat(F.lit("/target/"), "filename").alias("path"))
    return R.flag_template_conflicts(plan, held).select("source", "conflict")


@query("W7_latest_per_key", """
SELECT drive, event_id, temperature FROM (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""")
def latest(t):
    return W.latest_per_key(t.readings, ["drive"], ["ts", "event_id"]).select("drive", "event_id", "temperature")


BURSTS_SQL = """shots AS (SELECT path, folder, camera_short AS camera, extension, coalesce(taken_ts, modified_ts) AS ts FROM inventory WHERE file_type = 'IMAGE'),
gaps AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY camera ORDER BY ts, path)) <= 1 THEN 0 ELSE 1 END AS fresh FROM shots),
isles AS (SELECT *, sum(fresh) OVER (PARTITION BY camera ORDER BY ts, path ROWS UNBOUNDED PRECEDING) AS isle FROM gaps),
sized AS (SELECT camera, isle, count(*) AS n, min(ts) AS start FROM isles GROUP BY camera, isle HAVING count(*) >= 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY start) AS burst_index FROM sized)"""


@query("W8_bursts", f"""
WITH {BURSTS_SQL} SELECT i.path, coalesce(n.burst_index, 0) AS burst_index, coalesce(n.n, 0) AS burst_size FROM isles i LEFT JOIN numbered n ON n.camera = i.camera AND n.isle = i.isle""")
def bursts(t):
    taken = D.first_parsed(c("date_taken"), c("modified"))
    shots = t.inventory.filter("file_type = 'IMAGE'").select("path", N.camera_short(N.full_camera(c("camera_make"), c("camera_model"))).alias("camera"), taken.alias("ts"))
    return W.bursts(shots, "ts", "camera").select("path", F.coalesce("burst_index", F.lit(0)).alias("burst_index"), F.coalesce("burst_size", F.lit(0)).alias("burst_size"))


@query("W9_month_on_month_change", """
SELECT month, files_ingested, coalesce(files_ingested - lag(files_ingested) OVER (ORDER BY month), 0) AS change,
  coalesce(round(100.0 * (files_ingested - lag(files_ingested) OVER (ORDER BY month)) / lag(files_ingested) OVER (ORDER BY month), 2), 0) AS change_pct
FROM (SELECT strftime(ingested_date, '%Y-%m') AS month, count(*) AS files_ingested FROM assets GROUP BY 1)""")
def month_change(t):
    m = A.monthly_ingestion(t.assets).select("month", "files_ingested")
    return W.month_change(m, "files_ingested").fillna(0, ["change", "change_pct"])


@query("W10_growth", """
SELECT month, total_bytes, CAST(sum(total_bytes) OVER (ORDER BY month) AS BIGINT) AS running FROM (SELECT strftime(ingested_date, '%Y-%m') AS month, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes FROM assets GROUP BY 1)""")
def growth(t):
    return W.growth(A.monthly_ingestion(t.assets).select("month", "total_bytes"), "total_bytes")


@query("W11_next_sequence", """
SELECT task_type, coalesce(TRY_CAST(list_last(string_split(max(task_id), '_')) AS BIGINT) + 1, 1) AS next_seq FROM task_log WHERE task_id LIKE 'TASK_19970115%' GROUP BY task_type""")
def next_sequence(t):
    return W.next_sequence(t.task_log, "19970115")


@query("W12_last_n_per_key", """
SELECT drive, event_id, temperature FROM (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn <= 25""")
def last_n(t):
    return W.last_n(t.readings, "drive", ["ts", "event_id"], 25).select("drive", "event_id", "temperature")


@query("W13_retention", """
WITH b AS (SELECT o_custkey % 50 AS source, o_orderdate AS ts, o_orderkey AS id FROM orders),
slots AS (SELECT *, 'day' AS period, 7 AS n, date_trunc('day', ts) AS slot FROM b UNION ALL SELECT *, 'week', 4, date_trunc('week', ts) FROM b UNION ALL SELECT *, 'month', 12, date_trunc('month', ts) FROM b),
latest AS (SELECT source, period, n, slot, arg_max(id, (ts, id)) AS id FROM slots GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY slot DESC) AS rn FROM latest)
SELECT source, id, string_agg(period, ',' ORDER BY period) AS kept_as FROM kept WHERE rn <= n GROUP BY source, id""")
def retention(t):
    b = t.orders.select((c("o_custkey") % 50).alias("source"), c("o_orderdate").cast("timestamp").alias("ts"), c("o_orderkey").alias("id"))
    return W.keep_backups(b, "source", "ts").select("source", "id", "kept_as")
