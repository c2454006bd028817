"""Queries for aggregations, sorts, limits and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import paths as P
from assetlake.operators import aggregates as A
from assetlake.operators import filters as X
from assetlake.operators import joins as J
from assetlake.operators import sorting as L
from assetlake.workload.join_queries import COMPARED_SQL, INTEGRITY_SQL, RECONCILED_SQL, TRANSFER_SQL, backup_sides, catalog_side, transferred
from assetlake.workload.registry import query

c = F.col


@query("A1_count_and_size", "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inventory")
def count_and_size(t):
    return A.count_and_size(t.inventory)


@query("A2_count_by_type", "SELECT file_type, count(*) AS files FROM inventory GROUP BY file_type")
def count_by_type(t):
    return A.count_by_type(t.inventory)


@query("A3_timeline", "SELECT strftime(coalesce(taken_ts, modified_ts), '%Y-%m') AS month, count(*) AS files FROM inventory GROUP BY 1")
def timeline(t):
    return A.timeline(t.inventory)


@query("A3_timeline_strict", "SELECT strftime(coalesce(taken_ts, modified_ts), '%Y-%m') AS month, count(*) AS files FROM inventory WHERE asset_id % 3 <> 0 GROUP BY 1")
def timeline_strict(t):
    return A.timeline(t.inventory, strict=True)


@query("A4_monthly_ingestion", """
SELECT strftime(ingested_date, '%Y-%m') AS month, count(*) AS files_ingested, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes FROM assets GROUP BY 1""")
def monthly_ingestion(t):
    return A.monthly_ingestion(t.assets)


@query("A5_count_by_rating", "SELECT coalesce(rating, 0) AS rating, count(*) AS images FROM cat_images GROUP BY 1")
def by_rating(t):
    return A.count_by_rating(t.cat_images)


@query("A6_count_by_flag", """
SELECT f.flag, count(i.id) AS images FROM (VALUES ('picked'), ('rejected'), ('unflagged')) f(flag)
LEFT JOIN cat_images i ON f.flag = CASE i.pickFlags WHEN 1 THEN 'picked' WHEN -1 THEN 'rejected' ELSE 'unflagged' END GROUP BY f.flag""")
def by_flag(t):
    return A.count_by_flag(t.cat_images)


@query("A7_images_per_keyword", """
SELECT k.id, k.name, p.name AS parent_name, count(i.id_image) AS image_count FROM cat_keywords k LEFT JOIN cat_keywords p ON k.parent = p.id
LEFT JOIN cat_keyword_images i ON i.id_keyword = k.id GROUP BY k.id, k.name, p.name""")
def per_keyword(t):
    return J.with_parent_name(A.images_per_tag(t.cat_keywords, t.cat_keyword_images)).select("id", "name", "parent_name", "image_count")


@query("A8_images_per_collection", """
SELECT CAST(r.r_regionkey AS BIGINT) AS id, r.r_name AS name, count(c.c_custkey) AS image_count FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL""")
def per_collection(t):
    links = t.customer.select(c("c_custkey").alias("id_image"), c("c_nationkey").alias("n_nationkey")).join(t.nation, "n_nationkey").select(
        c("n_regionkey").cast("long").alias("id_collection"), "id_image")
    colls = t.region.select(c("r_regionkey").cast("long").alias("id"), c("r_name").alias("name"))
    return A.images_per_tag(colls, links, "id_collection")


@query("A9_files_per_folder", """
SELECT CAST(f.id AS INTEGER) AS id, r.absolutePath || f.pathFromRoot AS full_path, count(x.id) AS file_count FROM cat_folders f JOIN cat_roots r ON f.id_root = r.id LEFT JOIN cat_files x ON x.id_folder = f.id GROUP BY ALL""")
def per_folder(t):
    return A.files_per_folder(t.cat_folders, t.cat_roots, t.cat_files)


@query("A10_catalog_statistics", """
SELECT (SELECT count(*) FROM cat_images) AS total_images, (SELECT count(*) FROM cat_keywords) AS total_keywords, (SELECT count(*) FROM region) AS total_collections,
  (SELECT count(*) FROM cat_folders) AS total_folders, (SELECT count(*) FROM cat_develop WHERE exposure IS NOT NULL OR cropTop IS NOT NULL) AS images_with_develop""")
def catalog_statistics(t):
    return A.catalog_statistics({
        "total_images": t.cat_images, "total_keywords": t.cat_keywords, "total_collections": t.region, "total_folders": t.cat_folders,
        "images_with_develop": X.edited_images(t.cat_develop)})


@query("A11_backup_health", """
SELECT backup_location, count(*) AS total_assets, count(*) FILTER (backup_status = 'backed_up') AS backed_up_count, count(*) FILTER (backup_status = 'failed') AS failed_count,
  count(*) FILTER (backup_status = 'pending') AS pending_count, round(100.0 * count(*) FILTER (backup_status = 'backed_up') / count(*), 2) AS success_rate_pct,
  strftime(max(last_backup_at), '%Y-%m-%d %H:%M:%S') AS last_successful_backup FROM backups GROUP BY backup_location""")
def backup_health(t):
    return A.backup_health(t.backups).withColumn("last_successful_backup", F.date_format("last_successful_backup", "yyyy-MM-dd HH:mm:ss"))


@query("A12_library_summary", """
WITH p AS (SELECT * FROM assets WHERE NOT is_missing)
SELECT 'Total Assets' AS metric, CAST(count(*) AS DOUBLE) AS value FROM p UNION ALL SELECT 'Total Size (GB)', round(sum(file_size_bytes) / 1073741824.0, 2) FROM p
UNION ALL SELECT 'RAW Files', count(*) FROM p WHERE file_type = 'RAW' UNION ALL SELECT 'JPEG Files', count(*) FROM p WHERE file_type = 'JPG'
UNION ALL SELECT 'Video Files', count(*) FROM p WHERE file_type = 'VIDEO' UNION ALL SELECT 'Duplicates', count(*) FROM p WHERE is_duplicate
UNION ALL SELECT 'Missing Files', count(*) FROM assets WHERE is_missing
UNION ALL SELECT 'Not Backed Up', count(*) FROM p WHERE id NOT IN (SELECT asset_id FROM backups)
UNION ALL SELECT 'Not in Lightroom', count(*) FROM p WHERE file_type IN ('RAW', 'JPG') AND id NOT IN (SELECT asset_id FROM catalog_assets)""")
def library_summary(t):
    return A.library_summary(t.assets, t.backups, t.catalog_assets)


@query("A13_count_by_status", "SELECT status, count(*) AS files FROM task_log GROUP BY status")
def by_status(t):
    return A.count_by(t.task_log, "status")


@query("A13_status_pivot", """
SELECT task_type, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'PAUSED') AS paused, count(*) FILTER (status = 'COMPLETED') AS completed,
  count(*) FILTER (status = 'FAILED') AS failed FROM task_log GROUP BY task_type""")
def status_pivot(t):
    return A.status_pivot(t.task_log, ["RUNNING", "PAUSED", "COMPLETED", "FAILED"], ["task_type"])


@query("A14_drive_capacity", """
SELECT d.mount_path, CAST(d.capacity_bytes AS BIGINT) AS capacity_bytes, count(i.path) AS files, CAST(coalesce(sum(i.size_bytes), 0) AS BIGINT) AS used_bytes,
  round(100.0 * coalesce(sum(i.size_bytes), 0) / greatest(d.capacity_bytes, 1), 2) AS used_pct FROM drives d LEFT JOIN inventory i ON '/' || i.source = d.mount_path GROUP BY d.mount_path, d.capacity_bytes""")
def drive_capacity(t):
    return A.drive_capacity(t.inventory.withColumn("mount_path", F.concat(F.lit("/"), "source")), t.drives)


@query("A15_integrity_tally", f"""
WITH {INTEGRITY_SQL} SELECT count(*) AS total, count(*) FILTER (outcome = 'verified') AS verified, count(*) FILTER (outcome = 'mismatch') AS mismatch,
  count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome NOT IN ('verified', 'mismatch', 'missing')) AS error FROM chk""")
def integrity_tally(t):
    return A.integrity_tally(J.integrity(t.manifest, t.inventory))


@query("A16_transfer_tally", f"""
WITH {TRANSFER_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status LIKE 'SKIPPED%') AS skipped,
  count(*) FILTER (status = 'FAILED') AS failed, CAST(coalesce(sum(size_bytes) FILTER (status = 'VERIFIED'), 0) AS BIGINT) AS total_bytes FROM moved""")
def transfer_tally(t):
    return A.transfer_tally(transferred(t))


@query("A17_session_counts", "SELECT session, status, count(*) AS files FROM transfers GROUP BY session, status")
def session_counts(t):
    return A.session_counts(t.transfers)


@query("A18_backup_verdict", f"""
WITH {COMPARED_SQL} SELECT count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'extra') AS extra, count(*) FILTER (outcome = 'mismatch') AS mismatch,
  count(*) FILTER (outcome = 'verified') AS verified, CAST(sum(primary_size) FILTER (outcome = 'missing') AS BIGINT) AS missing_bytes,
  (SELECT count(*) FROM p) AS primary_files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM p) AS primary_bytes,
  CASE WHEN count(*) FILTER (outcome <> 'verified') = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  round((SELECT sum(size_bytes) / count(*) FROM p) * count(*) FILTER (outcome = 'missing'), 2) AS missing_bytes_estimate FROM cmp""")
def backup_verdict(t):
    primary, backup = backup_sides(t)
    return A.backup_verdict(J.compare_backup(primary, backup), primary)


@query("A19_reconciliation_counts", f"""
WITH {RECONCILED_SQL} SELECT count(*) FILTER (category IN ('A', 'B')) AS catalog_paths, count(*) FILTER (category = 'B') AS missing_count, count(*) FILTER (category = 'C') AS orphan_count,
  round(100.0 * count(*) FILTER (category = 'A') / greatest(count(*) FILTER (category IN ('A', 'B')), 1), 4) AS match_percentage FROM cats""")
def reconciliation_counts(t):
    return A.reconciliation_counts(J.reconcile(catalog_side(t), t.inventory))


@query("A19_category_shares", f"""
WITH {RECONCILED_SQL} SELECT category, count(*) AS files, CAST(round(100.0 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS share_pct FROM cats GROUP BY category""")
def category_shares(t):
    return A.category_shares(J.reconcile(catalog_side(t), t.inventory))


@query("A20_temperature_statistics", """
SELECT drive, min(temperature) AS min_temperature, max(temperature) AS max_temperature, round(avg(temperature), 2) AS avg_temperature FROM readings GROUP BY drive""")
def temperature_statistics(t):
    return A.temperature_statistics(t.readings)


@query("A21_hash_statistics", """
SELECT count(*) AS total_files, count(*) FILTER (l_returnflag <> 'A') AS successful, count(*) FILTER (l_returnflag = 'A') AS errors, CAST(sum(l_partkey * 1000) FILTER (l_returnflag <> 'A') AS BIGINT) AS total_size_bytes,
  round(sum(l_partkey * 1000) FILTER (l_returnflag <> 'A') / 1073741824.0, 3) AS total_size_gb, round(sum(l_quantity) FILTER (l_returnflag <> 'A'), 2) AS total_processing_time_ms,
  round(sum(l_quantity) FILTER (l_returnflag <> 'A') / count(*) FILTER (l_returnflag <> 'A'), 2) AS avg_processing_time_ms,
  round((sum(l_partkey * 1000) FILTER (l_returnflag <> 'A') / 1048576.0) / (sum(l_quantity) FILTER (l_returnflag <> 'A') / 1000.0), 2) AS throughput_mbps FROM lineitem""")
def hash_statistics(t):
    return A.hash_statistics(t.lineitem.select((c("l_partkey") * 1000).alias("size_bytes"), c("l_quantity").alias("processing_time_ms"),
                                               F.when(c("l_returnflag") == "A", "read error").alias("error")))


@query("A22_encoder_usage", """
SELECT CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE l_linestatus END AS encoder, count(*) AS thumbnails, round(avg(l_quantity), 2) AS avg_time_ms FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def encoder_usage(t):
    return A.encoder_usage(t.lineitem.select(F.when(c("l_returnflag") != "A", c("l_linestatus")).alias("thumbnail_encoder"), c("l_quantity").alias("thumbnail_time_ms")))


@query("A23_task_health", """
SELECT count(*) FILTER (status = 'RUNNING' AND progress_pct >= 0) AS healthy, count(*) FILTER (epoch(TIMESTAMP '2000-01-01 00:00:40') - epoch(last_heartbeat) >= 30 AND epoch(TIMESTAMP '2000-01-01 00:00:40') - epoch(last_heartbeat) < 60) AS warning,
  count(*) FILTER (status IN ('FAILED', 'CANCELLED')) AS failed, CASE WHEN count(*) FILTER (status IN ('FAILED', 'CANCELLED')) > 0 THEN 'critical' ELSE 'healthy' END AS overall FROM task_log""")
def task_health(t):
    return A.task_health(t.task_log, F.lit("2000-01-01 00:00:40").cast("timestamp"))


@query("A25_distinct_paths", "SELECT count(DISTINCT catalog_file_path) AS paths FROM catalog_assets")
def distinct_paths(t):
    return A.distinct_paths(t.catalog_assets, path="catalog_file_path")


@query("A26_sidecar_counts", """
SELECT status, count(*) AS sidecars, round(100.0 * count(*) / 500, 2) AS target_pct FROM manifest GROUP BY status""")
def sidecar_counts(t):
    return A.sidecar_counts(t.manifest.select("status", P.name(c("new_path")).alias("filename")), 500)


@query("A27_storage_by_type", """
SELECT file_type, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(100.0 * sum(size_bytes) / sum(sum(size_bytes)) OVER (), 2) AS share_pct FROM inventory GROUP BY file_type""")
def storage_by_type(t):
    return A.storage_by_type(t.inventory)


_ACTIVITY = """activity AS (SELECT o_orderdate AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'ingest' WHEN '2-HIGH' THEN 'dedupe' WHEN '3-MEDIUM' THEN 'catalog' WHEN '4-NOT SPECIFIED' THEN 'backup' ELSE 'report' END AS kind,
  o_custkey AS files, o_orderkey AS bytes, o_orderstatus = 'F' AS failed FROM orders)"""


def activity(t):
    p = c("o_orderpriority")
    kind = F.when(p == "1-URGENT", "ingest").when(p == "2-HIGH", "dedupe").when(p == "3-MEDIUM", "catalog").when(p == "4-NOT SPECIFIED", "backup").otherwise("report")
    return t.orders.select(c("o_orderdate").alias("ts"), kind.alias("kind"), c("o_custkey").alias("files"), c("o_orderkey").alias("bytes"), (c("o_orderstatus") == "F").alias("failed"))


ACTIVITY_SQL = f"""{_ACTIVITY}, act AS (
SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (kind = 'ingest') AS drives_ingested, CAST(coalesce(sum(files) FILTER (kind = 'ingest'), 0) AS BIGINT) AS files_transferred,
  CAST(coalesce(sum(files) FILTER (kind = 'dedupe'), 0) AS BIGINT) AS duplicates_removed, CAST(coalesce(sum(bytes) FILTER (kind = 'dedupe'), 0) AS BIGINT) AS space_recovered,
  count(*) FILTER (kind = 'catalog') AS catalog_updates, count(*) FILTER (kind = 'backup') AS backup_syncs, count(*) FILTER (kind = 'backup' AND failed) AS backup_failures,
  count(*) FILTER (kind = 'report') AS reports_generated FROM activity GROUP BY 1)"""


@query("A28_monthly_activity", f"WITH {ACTIVITY_SQL} SELECT * FROM act")
def monthly_activity(t):
    return A.monthly_activity(activity(t))


@query("A29_date_range", """
SELECT strftime(min(taken_ts), '%Y-%m-%d') AS first_date, strftime(max(taken_ts), '%Y-%m-%d') AS last_date, count(taken_ts) AS dated_files FROM inventory""")
def date_range(t):
    r = A.date_range(t.inventory, D.parse_taken(c("date_taken")))
    return r.select(F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "dated_files")


@query("A29_extension_shares", """
SELECT extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM inventory GROUP BY extension""")
def extension_shares(t):
    return A.extension_shares(t.inventory)


@query("A30_counts_by_folder", f"""
WITH {RECONCILED_SQL} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) FILTER (category = 'B') AS missing, count(*) FILTER (category = 'C') AS orphans FROM cats WHERE category <> 'A' GROUP BY 1""")
def by_folder(t):
    return A.counts_by_folder(J.reconcile(catalog_side(t), t.inventory), P.parent(c("path")))


@query("A31_audit_sample", """
SELECT path, sha256 FROM inventory ORDER BY md5('s1' || path), path LIMIT (SELECT greatest(ceil(count(*) * 0.05), 100) :: BIGINT FROM inventory)""")
def audit_sample(t):
    return A.audit_sample(t.inventory.select("path", "sha256"), seed="s1")


@query("A32_dashboard", """
SELECT (SELECT count(*) FROM inventory) AS files, (SELECT round(sum(size_bytes) / 1073741824.0, 2) FROM inventory) AS size_gb, (SELECT count(*) FROM inventory WHERE camera_make IS NOT NULL) AS verified,
  (SELECT count(*) FROM task_log WHERE status = 'COMPLETED') AS tasks_complete, (SELECT count(*) FROM task_log WHERE status = 'FAILED') AS tasks_failed""")
def dashboard(t):
    return A.dashboard(t.inventory.withColumn("verified", c("camera_make").isNotNull()), t.task_log)


@query("A32_files_per_drive", "SELECT source, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inventory GROUP BY source")
def per_drive(t):
    return A.files_per_drive(t.inventory, "source")


# --- sorts, limits, pages ------------------------------------------------------------

@query("L1_largest_files", "SELECT path, size_bytes FROM inventory ORDER BY size_bytes DESC, path LIMIT 20")
def largest(t):
    return L.largest_files(t.inventory.select("path", "size_bytes"))


@query("L2_first_without_metadata", """
SELECT path, file_type FROM inventory WHERE (file_type = 'IMAGE' AND date_taken = '' AND camera_make IS NULL AND camera_model IS NULL) OR (file_type = 'VIDEO' AND duration IS NULL AND codec IS NULL) ORDER BY path LIMIT 50""")
def first_without_metadata(t):
    return L.top(X.missing_metadata(t.inventory).select("path", "file_type"), 50, "path")


@query("L3_top_duplicate_groups", """
SELECT sha256, count(*) AS copies, max(size_bytes) AS size_bytes, CAST(max(size_bytes) * (count(*) - 1) AS BIGINT) AS recoverable_bytes FROM inventory GROUP BY sha256 HAVING count(*) > 1 ORDER BY count(*) DESC, sha256 LIMIT 20""")
def top_groups(t):
    from assetlake.plans.reports import top_groups as top

    return top(t.inventory)


@query("L4_sorted_by_column", "SELECT path, filename, size_bytes FROM inventory ORDER BY size_bytes DESC, path")
def sorted_by(t):
    return L.sort_by(t.inventory.select("path", "filename", "size_bytes"), "size_bytes", descending=True)


@query("L5_page", "SELECT path, filename, size_bytes FROM inventory WHERE size_bytes >= 500 ORDER BY filename, path LIMIT 25 OFFSET 50")
def page(t):
    return L.page(t.inventory.filter("size_bytes >= 500").select("path", "filename", "size_bytes"), 3, 25)[0]


@query("L5_deep_page", "SELECT path, filename, size_bytes FROM inventory ORDER BY size_bytes DESC, path LIMIT 25 OFFSET 150")
def deep_page(t):
    """A page found by counts between cuts, as one beyond the first ten thousand rows of a larger table is."""
    return L.page(t.inventory.select("path", "filename", "size_bytes"), 7, 25, "size_bytes", True, top_rows=60)[0]


@query("L5_page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM inventory WHERE size_bytes >= 500")
def page_total(t):
    return L.page(t.inventory.filter("size_bytes >= 500"), 3, 25)[1]


@query("L6_recent_tasks", "SELECT task_id, status FROM task_log ORDER BY started_at DESC, task_id LIMIT 10")
def recent(t):
    from assetlake.operators.tasks import recent as newest

    return newest(t.task_log, 10).select("task_id", "status")


@query("L7_last_completed_operations", """SELECT operation_id, "timestamp" FROM manifest WHERE status = 'completed' ORDER BY "timestamp" DESC, operation_id LIMIT 50""")
def last_completed(t):
    return L.top(t.manifest.filter("status = 'completed'").select("operation_id", "timestamp"), 50, F.desc("timestamp"), "operation_id")


@query("L8_first_of_plan", "SELECT original_path, new_path FROM manifest ORDER BY original_path LIMIT 500")
def first_of_plan(t):
    return L.top(t.manifest.select("original_path", "new_path"), 500, "original_path")


@query("L9_ranked_by_case", """
SELECT id, CASE WHEN file_type = 'RAW' THEN 'CRITICAL' WHEN lightroom_rating >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM assets""")
def ranked(t):
    level = F.when(c("file_type") == "RAW", "CRITICAL").when(c("lightroom_rating") >= 4, "HIGH").otherwise("MEDIUM")
    return t.assets.select("id", level.alias("priority")).orderBy(L.rank_order(c("priority"), "CRITICAL", "HIGH", "MEDIUM"), "id")


@query("L10_null_safe_order", "SELECT task_id, status FROM task_log ORDER BY last_heartbeat NULLS FIRST, task_id")
def null_safe_order(t):
    return t.task_log.orderBy(F.asc("last_heartbeat"), F.asc("task_id")).select("task_id", "status")
