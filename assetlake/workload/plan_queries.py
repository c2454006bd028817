"""Queries for rename, transfer, roll-back, reconciliation and report datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.plans import reconcile as K
from assetlake.plans import rename as R
from assetlake.plans import reports as S
from assetlake.plans import transfer as X
from assetlake.workload.aggregate_queries import ACTIVITY_SQL, activity
from assetlake.workload.duplicate_queries import GROUPS_SQL
from assetlake.workload.join_queries import RECONCILED_SQL, TRANSFER_SQL, catalog_side, transferred
from assetlake.workload.registry import query
from assetlake.workload.window_queries import BURSTS_SQL

c = F.col

PLAN_SQL = """photos AS (SELECT path, folder, camera_short, extension, coalesce(taken_ts, modified_ts) AS ts, CASE WHEN date_taken <> '' THEN date_taken ELSE modified END AS sort_text FROM inventory WHERE file_type = 'IMAGE'),
seqd AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY sort_text, path) AS seq FROM photos),
plan AS (SELECT path AS old_path, folder || '/' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || camera_short || '_' || printf('%04d', seq) || extension AS new_path, 'rename_' || substr(extension, 2) AS reason FROM seqd)"""


@query("O1_rename_plan", f"WITH {PLAN_SQL} SELECT old_path, new_path, reason, CASE WHEN row_number() OVER (PARTITION BY lower(new_path) ORDER BY old_path) > 1 THEN 'CONFLICT' ELSE 'ok' END AS conflict_check FROM plan")
def rename_plan(t):
    return R.audit_plan(t.inventory)


# Every photo beside a copy under another name, and numbers that restart with each file: the two want one name.
_CLASH_SQL = """WITH both_ AS (SELECT * FROM inventory UNION ALL SELECT * REPLACE (regexp_replace(path, '(\\.[^.]+)$', '_copy\\1') AS path) FROM inventory),
plan AS (SELECT path AS old_path, folder || '/' || strftime(coalesce(taken_ts, modified_ts), '%Y-%m-%d_%H-%M-%S') || '_' || camera_short || '_0001' || extension AS new_path, 'rename_' || substr(extension, 2) AS reason
  FROM both_ WHERE file_type = 'IMAGE'),
marked AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lower(new_path) ORDER BY old_path) > 1 THEN 'CONFLICT' ELSE 'ok' END AS conflict_check FROM plan)"""


def _clashing(t):
    return t.inventory.unionByName(t.inventory.withColumn("path", F.regexp_replace("path", r"(\.[^.]+)$", "_copy$1")))


@query("O1_rename_plan_with_conflicts", f"{_CLASH_SQL} SELECT * FROM marked")
def rename_plan_with_conflicts(t):
    return R.audit_plan(_clashing(t), ("path",))


@query("A24_rename_conflict_statistics", f"""
{_CLASH_SQL}, k AS (SELECT count(*) AS conflicts, count(DISTINCT lower(new_path)) AS conflict_targets FROM marked WHERE conflict_check = 'CONFLICT')
SELECT count(*) AS total, count(*) FILTER (file_type = 'IMAGE') AS renamed, count(*) FILTER (file_type <> 'IMAGE') AS skipped_not_photo, CAST(0 AS BIGINT) AS skipped_no_date,
  any_value(conflicts) AS conflicts, any_value(conflict_targets) AS conflict_targets FROM both_, k""")
def rename_conflict_statistics(t):
    files = _clashing(t)
    return R.audit_plan_statistics(files, R.audit_plan(files, ("path",)))


@query("A24_rename_statistics", """
SELECT count(*) AS total, count(*) FILTER (file_type = 'IMAGE') AS renamed, count(*) FILTER (file_type <> 'IMAGE') AS skipped_not_photo, CAST(0 AS BIGINT) AS skipped_no_date,
  CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS conflict_targets FROM inventory""")
def rename_statistics(t):
    return R.audit_plan_statistics(t.inventory, R.audit_plan(t.inventory))


@query("O2_template_plan", """
WITH f AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN min(path) OVER w ELSE path END AS lead_path, CASE WHEN count(*) OVER w > 1 THEN folder || '/' || stem END AS pair_base
  FROM inventory WHERE file_type = 'IMAGE' WINDOW w AS (PARTITION BY folder, stem)), n AS (SELECT *, dense_rank() OVER (ORDER BY lead_path) AS seq FROM f),
h AS (SELECT n.lead_path, strftime(coalesce(n.taken_ts, n.modified_ts), '%Y%m%d') || '_' || coalesce(replace(n.camera_model, ' ', '_'), 'Unknown') || '_' || printf('%03d', n.seq) AS new_stem FROM n WHERE n.path = n.lead_path)
SELECT n.path AS source, n.folder || '/' || h.new_stem || regexp_extract(n.path, '\\.[^.]+$') AS destination, n.pair_base, n.seq FROM n JOIN h ON h.lead_path = n.lead_path""")
def template_plan(t):
    return R.template_plan(t.inventory, "{YYYY}{MM}{DD}_{camera_model}_{sequence}", t.inventory).select("source", "destination", "pair_base", "seq")


@query("O2_burst_names", f"""
WITH {BURSTS_SQL}, b AS (SELECT i.*, n.burst_index, n.n AS burst_size FROM isles i JOIN numbered n ON n.camera = i.camera AND n.isle = i.isle)
SELECT path AS old_path, burst_index, burst_size, folder || '/' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || camera || '_burst' || burst_index || '_' ||
  printf('%04d', row_number() OVER (PARTITION BY camera, burst_index ORDER BY ts, path)) || extension AS new_path FROM b""")
def burst_names(t):
    return R.burst_plan(t.inventory).select("old_path", "burst_index", "burst_size", "new_path")


@query("O2_document_names", """
SELECT path AS old_path, folder || '/' || strftime(coalesce(taken_ts, modified_ts), '%Y-%m-%d') || '_Document_' || stem || '_' || substr(sha256, 1, 8) || regexp_extract(path, '\\.[^.]+$') AS new_path FROM inventory""")
def document_names(t):
    return R.document_plan(t.inventory)


@query("P9_resolved_conflicts", """
SELECT path AS old_path, '/all/' || CASE WHEN row_number() OVER (PARTITION BY lower(filename) ORDER BY path) > 1 THEN stem || '_' || substr(sha256, 1, 8) || regexp_extract(path, '\\.[^.]+$') ELSE filename END AS new_path FROM inventory""")
def resolved_conflicts(t):
    from assetlake.operators.windows import flag_conflicts

    plan = t.inventory.select(c("path").alias("old_path"), F.concat(F.lit("/all/"), "filename").alias("new_path"))
    flagged = flag_conflicts(plan, F.lower("new_path"), ["old_path"]).select(
        "old_path", "new_path", F.when(c("conflict"), "CONFLICT").otherwise("ok").alias("conflict_check"))
    return R.resolve_conflicts(flagged, t.inventory).select("old_path", "new_path")


@query("O3_operation_manifest", f"""
WITH {PLAN_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY old_path) AS seq FROM plan)
SELECT 'OP_20240115_000000_' || printf('%04d', seq) AS operation_id, old_path AS original_path, new_path, i.filename AS original_filename, split_part(new_path, '/', 4) AS new_filename, 'pending' AS status,
  i.size_bytes AS file_size, 'CP_OP_20240115_000000_' || printf('%04d', seq) AS checkpoint_id FROM n JOIN inventory i ON i.path = n.old_path""")
def operation_manifest(t):
    m = X.operation_manifest(R.audit_plan(t.inventory), "20240115_000000", "2024-01-15T00:00:00", None, t.inventory)
    return m.select("operation_id", "original_path", "new_path", "original_filename", "new_filename", "status", "file_size", "checkpoint_id")


@query("O3_first_batch_manifest", """
SELECT 'OP_20240115_000000_' || printf('%04d', row_number() OVER (ORDER BY original_path)) AS operation_id, original_path, new_path FROM (SELECT original_path, new_path FROM manifest ORDER BY original_path LIMIT 500)""")
def first_batch(t):
    plan = t.manifest.select(c("original_path").alias("old_path"), "new_path")
    return X.operation_manifest(plan, "20240115_000000", "2024-01-15T00:00:00", 500).select("operation_id", "original_path", "new_path")


@query("O4_transfer_outcomes", f"WITH {TRANSFER_SQL} SELECT status, count(*) AS operations, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM moved GROUP BY status")
def transfer_outcomes(t):
    return transferred(t).groupBy("status").agg(F.count("*").alias("operations"), F.sum("size_bytes").alias("bytes"))


@query("O5_rollback_plan", """
WITH last AS (SELECT * FROM manifest WHERE status = 'completed' ORDER BY "timestamp" DESC, operation_id LIMIT 50),
s AS (SELECT l.*, i.sha256 AS cur, CASE WHEN i.path IS NULL THEN 'skipped' WHEN l.hash_after <> '' AND i.sha256 <> l.hash_after THEN 'failed' ELSE 'dry_run' END AS st FROM last l LEFT JOIN inventory i ON i.path = l.new_path)
SELECT operation_id, st AS status, CASE st WHEN 'skipped' THEN 'New file does not exist' WHEN 'failed' THEN 'Hash mismatch: expected ' || substr(hash_after, 1, 16) || '..., got ' || substr(cur, 1, 16) || '...' END AS reason,
  CASE WHEN st = 'dry_run' THEN original_path END AS would_restore FROM s""")
def rollback_plan(t):
    return X.rollback_plan(t.manifest, t.inventory)


@query("O6_rollback_candidates", """SELECT operation_id FROM manifest WHERE status = 'completed' AND "timestamp" >= '2023-01-10T00:00:00'""")
def rollback_candidates(t):
    return X.rollback_candidates(t.manifest, "2023-01-20 00:00:00", 24 * 10).select("operation_id")


@query("O6_operation_integrity", """
SELECT m.operation_id, i.path IS NOT NULL AND m.hash_before <> '' AND i.sha256 = CASE WHEN m.hash_after <> '' THEN m.hash_after ELSE m.hash_before END AS is_valid,
  CASE WHEN i.path IS NULL THEN 'File does not exist' WHEN m.hash_before = '' THEN 'No hash_before recorded'
    WHEN i.sha256 = CASE WHEN m.hash_after <> '' THEN m.hash_after ELSE m.hash_before END THEN 'Hash verified: ' || substr(i.sha256, 1, 16) || '...'
    ELSE 'Hash mismatch: expected ' || substr(CASE WHEN m.hash_after <> '' THEN m.hash_after ELSE m.hash_before END, 1, 16) || '..., got ' || substr(i.sha256, 1, 16) || '...' END AS message
FROM manifest m LEFT JOIN inventory i ON i.path = m.new_path""")
def operation_integrity(t):
    return X.operation_integrity(t.manifest, t.inventory).select("operation_id", "is_valid", "message")


@query("O7_reconciliation_matrix", f"""
WITH {RECONCILED_SQL}, orphan AS (SELECT i.sha256, min(i.path) AS found_path FROM cats JOIN inventory i ON cats.path = i.path WHERE category = 'C' GROUP BY i.sha256)
SELECT cats.path, category, CASE category WHEN 'B' THEN 'CRITICAL' WHEN 'C' THEN 'HIGH' ELSE 'NONE' END AS priority, CASE WHEN category = 'B' THEN o.found_path END AS found_path
FROM cats LEFT JOIN cat ON cat.path = cats.path LEFT JOIN orphan o ON o.sha256 = cat.sha256
UNION ALL SELECT path, 'D', 'MEDIUM', NULL FROM inventory WHERE sha256 IN (SELECT sha256 FROM inventory GROUP BY sha256 HAVING count(*) > 1)""")
def reconciliation_matrix(t):
    return K.reconciliation_matrix(catalog_side(t), t.inventory.select("path", "sha256", "size_bytes"))


@query("O8_backup_priorities", """
SELECT a.id, a.file_path, CASE WHEN a.file_type = 'RAW' THEN 'CRITICAL' WHEN a.lightroom_rating >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM assets a LEFT JOIN backups b ON a.id = b.asset_id WHERE b.asset_id IS NULL OR b.backup_status <> 'backed_up'""")
def backup_priorities(t):
    return K.backup_priorities(t.assets, t.backups).select("id", "file_path", "priority")


@query("O8_not_in_catalog", """
SELECT id, file_path FROM assets WHERE file_type IN ('RAW', 'JPG') AND file_path NOT LIKE '%SCREENSHOTS%' AND file_path NOT LIKE '%EDITED%' AND id NOT IN (SELECT asset_id FROM catalog_assets)""")
def not_in_catalog(t):
    return K.not_in_catalog(t.assets, t.catalog_assets).select("id", "file_path")


@query("O9_phased_upload", """
SELECT a.id, a.file_path, a.file_size_bytes FROM assets a LEFT JOIN backups b ON a.id = b.asset_id AND b.backup_location = 'r2' WHERE a.date_taken >= TIMESTAMP '2023-04-15' AND (b.asset_id IS NULL OR b.backup_status <> 'backed_up')""")
def phased_upload(t):
    return K.phased_upload(t.assets, t.backups, "2024-04-15").select("id", "file_path", "file_size_bytes")


@query("O10_copies_of_an_asset", """
SELECT id, file_path, nickname FROM (SELECT a.id, a.file_path, d.nickname, row_number() OVER (PARTITION BY a.id ORDER BY length(d.mount_path) DESC) AS rn FROM assets a LEFT JOIN drives d ON starts_with(a.file_path, d.mount_path)
WHERE a.sha256_hash = (SELECT sha256_hash FROM assets GROUP BY sha256_hash ORDER BY count(*) DESC, sha256_hash DESC LIMIT 1)) WHERE rn = 1""")
def copies_of(t):
    n = t.assets.groupBy("sha256_hash").agg(F.count("*").alias("n"))
    most = n.select(F.max_by("sha256_hash", F.struct("n", "sha256_hash"))).scalar()
    return K.copies_of(t.assets, t.drives, most).select("id", "file_path", "nickname")


@query("O11_assets_on_drive", """
SELECT a.id, a.file_path, b.backup_status FROM assets a LEFT JOIN backups b ON a.id = b.asset_id AND b.backup_location = 'local'
WHERE starts_with(a.file_path, '/src7/') OR starts_with(a.file_path, (SELECT max(mount_path) FROM drives WHERE serial_number = 'SN-src3'))""")
def on_drive(t):
    return K.assets_on_drive(t.assets, t.backups, t.drives, "SN-src3", "/src7/").select("id", "file_path", "backup_status")


@query("O12_audit_report_totals", f"""
WITH g AS ({GROUPS_SQL}) SELECT count(*) AS total_files, round(sum(size_bytes) / 1073741824.0, 2) AS total_size_gb, count(*) FILTER (file_type = 'IMAGE') AS image_count, count(*) FILTER (file_type = 'VIDEO') AS video_count,
  (SELECT count(*) FROM g) AS duplicate_groups, (SELECT round(coalesce(sum(recoverable_bytes), 0) / 1073741824.0, 2) FROM g) AS duplicate_space_gb,
  count(*) FILTER ((file_type = 'IMAGE' AND date_taken = '' AND camera_make IS NULL AND camera_model IS NULL) OR (file_type = 'VIDEO' AND duration IS NULL AND codec IS NULL)) AS no_metadata_count FROM inventory""")
def report_totals(t):
    return S.audit_totals(t.inventory)


@query("O12_audit_report_manifest", """
SELECT filename, path, round(size_bytes / 1048576.0, 2) AS size_mb, file_type, CASE file_type WHEN 'IMAGE' THEN 'image' WHEN 'VIDEO' THEN 'video' ELSE 'other' END AS badge, camera_model, date_taken, substr(sha256, 1, 16) || '...' AS sha256 FROM inventory""")
def report_manifest(t):
    return S.audit_report(t.inventory)["all_files"]


def _monthly(t):
    files = t.assets.select("ingested_date", "file_type", c("file_size_bytes").alias("size_bytes"))
    runs = t.orders.select(c("o_orderdate").cast("timestamp").alias("start_time"), c("o_orderpriority").alias("source"), c("o_custkey").alias("files"),
                           c("o_orderkey").alias("bytes"), c("o_orderstatus").alias("status"))
    return S.monthly_report(files, runs, activity(t), "1997-01")


@query("O13_monthly_growth", """
WITH m AS (SELECT strftime(ingested_date, '%Y-%m') AS month, count(*) AS files_ingested, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes FROM assets GROUP BY 1)
SELECT *, CAST(sum(files_ingested) OVER (ORDER BY month) AS BIGINT) AS total_files, CAST(sum(total_bytes) OVER (ORDER BY month) AS BIGINT) AS total_storage FROM m""")
def monthly_growth(t):
    return _monthly(t)["growth"]


@query("O13_top_ingests", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS source, o_custkey AS files, o_orderkey AS bytes FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-01' ORDER BY o_custkey DESC, o_orderdate, o_orderpriority LIMIT 10""")
def top_ingests(t):
    return _monthly(t)["top_ingests"].select(F.date_format("start_time", "yyyy-MM-dd").alias("day"), "source", "files", "bytes")


@query("O13_month_activity", f"WITH {ACTIVITY_SQL} SELECT * FROM act WHERE month = '1997-01'")
def month_activity(t):
    return _monthly(t)["activity"]


@query("O14_run_verdict", """
SELECT l_orderkey AS run, count(*) AS steps, count(*) FILTER (l_returnflag = 'A') AS failed_steps, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'SUCCESS' END AS status,
  count(*) FILTER (l_returnflag = 'A' AND l_linenumber IN (1, 4, 6)) > 0 AS aborted FROM lineitem GROUP BY l_orderkey""")
def run_verdict(t):
    steps = F.array(*map(F.lit, ("audit", "report", "dedupe", "confirmation", "rename", "transfer", "backup_verify", "index", "summary")))
    return X.run_verdict(t.lineitem.select(c("l_orderkey").alias("run"), F.element_at(steps, c("l_linenumber")).alias("step"),
                                           F.when(c("l_returnflag") == "A", "FAILED").otherwise("SUCCESS").alias("status")))


@query("O15_library_destination", """
SELECT path, CASE file_type WHEN 'VIDEO' THEN '02_VIDEOS' WHEN 'IMAGE' THEN '01_PHOTOS' ELSE '03_PROJECTS' END || '/' || CASE WHEN taken_ts IS NULL THEN 'UNKNOWN_DATE' ELSE strftime(taken_ts, '%Y/%m') END || '/' || filename AS destination FROM inventory""")
def library_destination(t):
    return R.library_plan(t.inventory)


@query("S6_manifest_positions", "SELECT operation_id, new_path, CAST(position AS BIGINT) AS position FROM manifest")
def manifest_positions(t):
    """Operations nested per document, then exploded again."""
    docs = t.manifest.groupBy(F.floor(c("position") / 1000).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("position", "operation_id", "new_path"))).alias("operations"))
    return docs.select(F.explode("operations").alias("op")).select("op.operation_id", "op.new_path", "op.position")
