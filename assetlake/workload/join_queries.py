"""Queries for joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import paths as P
from assetlake.operators import folders as M
from assetlake.operators import joins as J
from assetlake.operators import sets as U
from assetlake.operators.skew import attach
from assetlake.workload.registry import query

c = F.col

_IMAGES = """SELECT i.id, i.rating, r.absolutePath || f.pathFromRoot || x.baseName || '.' || x.extension AS full_path, f.id AS id_folder
FROM cat_images i JOIN cat_files x ON i.id_file = x.id JOIN cat_folders f ON x.id_folder = f.id JOIN cat_roots r ON f.id_root = r.id"""


@query("J1_catalog_image_chain", f"SELECT id, coalesce(rating, 0) AS rating, full_path FROM ({_IMAGES})")
def image_chain(t):
    return J.catalog_images(t.cat_images, t.cat_files, t.cat_folders, t.cat_roots).select("id", F.coalesce("rating", F.lit(0)).alias("rating"), "full_path")


@query("J2_images_with_develop_settings", "SELECT i.id, d.exposure, d.processVersion FROM cat_images i LEFT JOIN cat_develop d ON i.id = d.id")
def with_develop(t):
    return J.with_develop(t.cat_images, t.cat_develop).select("id", "exposure", "processVersion")


@query("J3_keep_delete_pairs", """
SELECT keep_path, path AS delete_path, sha256 AS hash, size_bytes, 'Duplicate of ' || keep_name AS reason FROM (
  SELECT path, sha256, size_bytes, first_value(path) OVER w AS keep_path, first_value(filename) OVER w AS keep_name, row_number() OVER w AS rn
  FROM inventory WINDOW w AS (PARTITION BY sha256 ORDER BY length(path), path)) WHERE rn > 1""")
def keep_delete(t):
    from assetlake.operators.duplicates import keep_delete_pairs, recommendations

    return keep_delete_pairs(recommendations(t.inventory))


@query("J4_keyword_parents", "SELECT k.id, k.name, p.name AS parent_name FROM cat_keywords k LEFT JOIN cat_keywords p ON k.parent = p.id")
def keyword_parents(t):
    return J.with_parent_name(t.cat_keywords).select("id", "name", "parent_name")


@query("J5_duplicate_pair_paths", """
SELECT a1.file_path AS file_path_1, a2.file_path AS file_path_2, 'exact' AS duplicate_type, CAST(1.0 AS DOUBLE) AS similarity_score
FROM (SELECT min(asset_id) AS k, sha256 FROM inventory GROUP BY sha256 HAVING count(*) > 1) g JOIN inventory i ON i.sha256 = g.sha256 AND i.asset_id > g.k
JOIN assets a1 ON a1.id = g.k JOIN assets a2 ON a2.id = i.asset_id WHERE i.camera_make IS NOT NULL""")
def pair_paths(t):
    files = t.inventory.select("asset_id", "sha256", "camera_make")
    firsts = files.groupBy("sha256").agg(F.min("asset_id").alias("asset_id_1"), F.count("*").alias("n")).filter("n > 1")
    pairs = attach(files, firsts, ["sha256"]).filter("asset_id > asset_id_1").select(
        "asset_id_1", c("asset_id").alias("asset_id_2"), F.lit("exact").alias("duplicate_type"), F.lit(1.0).alias("similarity_score"),
        F.when(c("camera_make").isNotNull(), "pending").otherwise("kept").alias("action_taken"))
    return J.duplicate_paths(pairs, t.assets)


@query("J6_without_backup", """
SELECT a.id, a.file_path FROM assets a LEFT JOIN backups b ON a.id = b.asset_id WHERE b.asset_id IS NULL OR b.backup_status <> 'backed_up'""")
def without_backup(t):
    return J.without_backup(t.assets, t.backups).select("id", "file_path")


@query("J6_without_backup_per_asset", """
SELECT a.id, a.file_path FROM assets a LEFT JOIN (SELECT asset_id, bool_and(backup_status = 'backed_up') AS ok FROM backups GROUP BY asset_id) b ON a.id = b.asset_id WHERE b.ok IS NULL OR NOT b.ok""")
def without_backup_per_asset(t):
    return J.without_backup(t.assets, t.backups, per_asset=True).select("id", "file_path")


@query("J7_backup_at_location", """
SELECT a.id, a.file_path, b.backup_status FROM assets a LEFT JOIN backups b ON a.id = b.asset_id AND b.backup_location = 'local'""")
def backup_at(t):
    return J.with_backup_at(t.assets, t.backups, "local").select("id", "file_path", "backup_status")


_SIDES = """p AS (SELECT substr(path, 2) AS rel_path, sha256, size_bytes FROM inventory WHERE camera_make IS NOT NULL),
b AS (SELECT substr(i.path, 2) AS rel_path, CASE WHEN l.quality = 1 THEN i.sha256 ELSE reverse(i.sha256) END AS sha256, i.size_bytes FROM inventory i JOIN labels l ON l.doc_id = i.asset_id)"""
COMPARED_SQL = f"""{_SIDES}, cmp AS (
SELECT coalesce(p.rel_path, b.rel_path) AS rel_path, p.sha256 AS primary_hash, p.size_bytes AS primary_size,
  CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN p.sha256 IS NULL THEN 'extra' WHEN p.sha256 <> b.sha256 THEN 'mismatch' ELSE 'verified' END AS outcome
FROM p FULL JOIN b ON p.rel_path = b.rel_path)"""


def backup_sides(t):
    files = t.inventory.withColumn("rel_path", P.relative_to(c("path"), "/"))
    primary = files.filter("camera_make is not null")
    backup = files.join(t.labels.select(c("doc_id").alias("asset_id"), "quality"), "asset_id").withColumn(
        "sha256", F.when(c("quality") == 1, c("sha256")).otherwise(F.reverse("sha256")))
    return primary.select("rel_path", "sha256", "size_bytes"), backup.select("rel_path", "sha256", "size_bytes")


@query("J8_backup_comparison", f"WITH {COMPARED_SQL} SELECT rel_path, outcome FROM cmp")
def backup_comparison(t):
    return J.compare_backup(*backup_sides(t)).select("rel_path", "outcome")


@query("J8_backup_comparison_by_folder", f"WITH {COMPARED_SQL} SELECT rel_path, outcome FROM cmp")
def backup_comparison_by_folder(t):
    return M.compare_backup_by_folder(*backup_sides(t)).select("rel_path", "outcome")


@query("J8_backup_trees", f"""
WITH {COMPARED_SQL}, steps AS (SELECT string_split(rel_path, '/') AS s, outcome FROM cmp), up AS (SELECT s, outcome, unnest(range(len(s))) AS n FROM steps)
SELECT array_to_string(s[:n], '/') AS folder, count(*) FILTER (outcome <> 'extra') AS files_1, count(*) FILTER (outcome <> 'missing') AS files_2, bool_and(outcome = 'verified') AS same
FROM up GROUP BY 1""")
def backup_trees(t):
    return M.compare_trees(*backup_sides(t))


RECONCILED_SQL = """cat AS (SELECT DISTINCT catalog_file_path AS path, sha256 FROM catalog_assets),
cats AS (SELECT coalesce(k.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'B' WHEN k.path IS NULL THEN 'C' ELSE 'A' END AS category
  FROM cat k FULL JOIN inventory d ON k.path = d.path WHERE k.path IS NOT NULL OR d.file_type <> 'OTHER')"""


def catalog_side(t):
    return t.catalog_assets.select(c("catalog_file_path").alias("path"), "sha256")


@query("J9_moved_files", f"""
WITH {RECONCILED_SQL} SELECT m.path AS missing_path, m.sha256, o.found_path, o.places
FROM (SELECT cats.path, cat.sha256 FROM cats JOIN cat ON cats.path = cat.path WHERE category = 'B') m
JOIN (SELECT i.sha256, min(i.path) AS found_path, count(*) AS places FROM cats JOIN inventory i ON cats.path = i.path WHERE category = 'C' GROUP BY i.sha256) o ON m.sha256 = o.sha256""")
def moved_files(t):
    cats = J.reconcile_hashes(catalog_side(t), t.inventory)
    missing = cats.filter("category = 'B'").select("path", c("catalog_sha256").alias("sha256"))
    orphan = cats.filter("category = 'C'").select("path", c("disk_sha256").alias("sha256"))
    return J.moved_files(missing, orphan)


@query("J10_catalog_reconciliation", f"WITH {RECONCILED_SQL} SELECT path, category FROM cats")
def reconciliation(t):
    return J.reconcile(catalog_side(t), t.inventory)


@query("J11_catalog_presence", """
SELECT path, path IN (SELECT catalog_file_path FROM catalog_assets) OR folder || '/' || stem IN (SELECT regexp_replace(catalog_file_path, '\\.[^.]+$', '') FROM catalog_assets) AS in_catalog FROM inventory""")
def presence(t):
    return J.catalog_presence(t.inventory.select("path"), t.catalog_assets.select("catalog_file_path"))


@query("J12_files_in_catalog", "SELECT path, size_bytes FROM inventory WHERE path IN (SELECT catalog_file_path FROM catalog_assets)")
def files_in_catalog(t):
    return J.in_catalog(t.inventory.select("path", "size_bytes"), t.catalog_assets.select("catalog_file_path"))


@query("J13_drive_of_path", """
SELECT id, file_path, nickname FROM (SELECT a.id, a.file_path, d.nickname, row_number() OVER (PARTITION BY a.id ORDER BY length(d.mount_path) DESC) AS rn
FROM assets a LEFT JOIN drives d ON starts_with(a.file_path, d.mount_path)) WHERE rn = 1""")
def drive_of_path(t):
    return J.with_drive(t.assets.select("id", "file_path"), t.drives).select("id", "file_path", "nickname")


@query("J13_all_drive_prefixes", "SELECT a.id, d.nickname FROM assets a LEFT JOIN drives d ON starts_with(a.file_path, d.mount_path)")
def all_prefixes(t):
    return J.with_drive(t.assets.select("id", "file_path"), t.drives, longest=False).select("id", "nickname")


@query("J14_mount_by_serial", "SELECT id, file_path FROM assets WHERE starts_with(file_path, (SELECT max(mount_path) FROM drives WHERE serial_number = 'SN-src3'))")
def mount_by_serial(t):
    return J.on_drive(t.assets, t.drives, "SN-src3").select("id", "file_path")


@query("J15_folder_drift", """
SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.n, 0) AS catalog_count, coalesce(b.n, 0) AS disk_count,
  CASE WHEN b.n IS NULL THEN 'lr_only' WHEN a.n IS NULL THEN 'disk_only' ELSE 'mismatched' END AS drift
FROM (SELECT regexp_replace(catalog_file_path, '/[^/]*$', '') AS folder, count(*) AS n FROM catalog_assets GROUP BY 1) a
FULL JOIN (SELECT folder, count(*) AS n FROM inventory GROUP BY 1) b ON a.folder = b.folder WHERE a.n IS DISTINCT FROM b.n""")
def folder_drift(t):
    cat = t.catalog_assets.select(P.parent(c("catalog_file_path")).alias("folder"))
    return J.folder_drift(cat, t.inventory).select(
        "folder", F.coalesce("catalog_count", F.lit(0)).alias("catalog_count"), F.coalesce("disk_count", F.lit(0)).alias("disk_count"), "drift")


@query("J17_raw_jpg_pairs", """
SELECT path, folder || '/' || stem AS pair_base FROM (SELECT *, count(*) OVER (PARTITION BY folder, stem) AS n FROM inventory WHERE extension IN ('.nef', '.cr2', '.jpg')) WHERE n > 1""")
def raw_jpg_pairs(t):
    return J.raw_jpg_pairs(t.inventory.select("path")).select("path", "pair_base")


@query("J18_raw_jpg_within_seconds", """
WITH base AS (SELECT path, camera_short AS cam, epoch(modified_ts) :: BIGINT // 1800 AS s, CASE WHEN extension = '.jpg' THEN 'J' ELSE 'R' END AS side FROM inventory WHERE extension IN ('.nef', '.cr2', '.jpg')),
one AS (SELECT cam, s, side, min(path) AS path FROM base GROUP BY cam, s, side),
cand AS (SELECT r.cam, r.path AS raw_path, j.path AS jpg_path, abs(j.s - r.s) AS gap FROM one r JOIN one j ON r.cam = j.cam AND r.side = 'R' AND j.side = 'J' AND j.s BETWEEN r.s - 5 AND r.s + 5),
picked AS (SELECT *, row_number() OVER (PARTITION BY raw_path ORDER BY gap, jpg_path) AS a, row_number() OVER (PARTITION BY jpg_path ORDER BY gap, raw_path) AS b FROM cand)
SELECT cam, raw_path, jpg_path, gap AS gap_seconds FROM picked WHERE a = 1 AND b = 1""")
def pair_by_time(t):
    from assetlake.functions import names as N

    # The given times lie an hour apart; here half an hour stands for a second.
    taken = F.timestamp_seconds(F.floor(F.unix_timestamp(F.to_timestamp("modified")) / 1800))
    files = t.inventory.select("path", taken.alias("taken"), N.camera_short(N.full_camera(c("camera_make"), c("camera_model"))).alias("cam"))
    return J.pair_by_time(files, "taken", by="cam")


@query("J19_three_way_compare", """
SELECT i.path, CASE WHEN i.sha256 IS DISTINCT FROM b.h THEN 'backup_corrupt' WHEN i.sha256 IS DISTINCT FROM k.sha256 THEN 'cloud_failed' ELSE 'verified' END AS outcome
FROM inventory i LEFT JOIN (SELECT path, CASE WHEN camera_make IS NULL THEN md5 ELSE sha256 END AS h FROM inventory) b ON b.path = i.path
LEFT JOIN (SELECT catalog_file_path AS path, sha256 FROM catalog_assets) k ON k.path = i.path""")
def three_way(t):
    files = t.inventory.select("path", "sha256")
    backup = t.inventory.select("path", F.when(c("camera_make").isNull(), c("md5")).otherwise(c("sha256")).alias("sha256"))
    return J.three_way_compare(files, files, backup, catalog_side(t)).select("path", "outcome")


INTEGRITY_SQL = """chk AS (SELECT m.operation_id, m.status, CASE WHEN m.status NOT IN ('completed', 'rolled_back') THEN 'not_completed' WHEN i.path IS NULL THEN 'missing'
  WHEN m.hash_after = '' AND m.hash_before = '' THEN 'no_reference' WHEN i.sha256 = CASE WHEN m.hash_after <> '' THEN m.hash_after ELSE m.hash_before END THEN 'verified' ELSE 'mismatch' END AS outcome,
  i.sha256 AS cur, CASE WHEN m.hash_after <> '' THEN m.hash_after ELSE m.hash_before END AS exp FROM manifest m LEFT JOIN inventory i ON i.path = m.new_path)"""


@query("J20_integrity_outcomes", f"""
WITH {INTEGRITY_SQL} SELECT operation_id, outcome, CASE outcome WHEN 'not_completed' THEN 'Operation not completed (status: ' || status || ')' WHEN 'missing' THEN 'File does not exist'
  WHEN 'no_reference' THEN 'No reference hash available' WHEN 'mismatch' THEN 'Hash mismatch: expected ' || substr(exp, 1, 32) || '..., got ' || substr(cur, 1, 32) || '...' ELSE '' END AS error FROM chk""")
def integrity(t):
    return J.integrity(t.manifest, t.inventory).select("operation_id", "outcome", "error")


@query("J21_pending_operations", "SELECT operation_id, new_path FROM manifest WHERE status NOT IN ('completed', 'rolled_back')")
def pending(t):
    done = t.manifest.filter("status in ('completed', 'rolled_back')")
    return J.pending_operations(t.manifest, done).select("operation_id", "new_path")


@query("J21_pending_by_position", "SELECT operation_id FROM manifest WHERE position > (SELECT avg(doc_id) FROM labels)")
def pending_position(t):
    return J.pending_after(t.manifest, t.labels.select(F.avg("doc_id")).scalar()).select("operation_id")


@query("J22_backup_listing", """
SELECT a.file_path, b.backup_location, b.backup_status FROM backups b JOIN assets a ON a.id = b.asset_id WHERE b.backup_status <> 'backed_up'""")
def backup_listing(t):
    return J.backup_listing(t.assets, t.backups, "backed_up").select("file_path", "backup_location", "backup_status")


@query("J23_missing_references", "SELECT k.catalog_file_path, a.file_path FROM catalog_assets k LEFT JOIN assets a ON a.id = k.asset_id WHERE k.is_missing")
def missing_references(t):
    return J.missing_references(t.catalog_assets, t.assets)


@query("J24_tagged_images", "SELECT k.id, k.name, i.id_image FROM cat_keywords k JOIN cat_keyword_images i ON k.id = i.id_keyword")
def tagged_images(t):
    return J.tagged_images(t.cat_keywords, t.cat_keyword_images).select("id", "name", "id_image")


TRANSFER_SQL = """ops AS (SELECT operation_id, path AS source_path, '/dest' || path AS dest_path, CASE WHEN asset_id % 4 = 0 THEN '' WHEN asset_id % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS expected_hash, sha256, asset_id, size_bytes,
    asset_id % 9 <> 0 AS has_src FROM manifest JOIN inventory ON asset_id = position),
chosen AS (SELECT o.*, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN o.sha256 ELSE reverse(o.sha256) END END AS old_hash, CASE WHEN o.asset_id % 17 <> 0 THEN CASE WHEN o.asset_id % 19 = 0 THEN reverse(o.sha256) ELSE o.sha256 END END AS new_hash FROM ops o LEFT JOIN labels l ON l.doc_id = o.asset_id),
moved AS (SELECT operation_id, CASE WHEN has_src THEN size_bytes ELSE 0 END AS size_bytes, CASE WHEN NOT has_src THEN 'SKIPPED' WHEN old_hash = CASE WHEN expected_hash = '' THEN sha256 ELSE expected_hash END THEN 'SKIPPED_EXISTING'
  WHEN expected_hash <> '' AND expected_hash <> sha256 THEN 'FAILED' WHEN new_hash IS NULL THEN 'FAILED' WHEN new_hash = sha256 THEN 'VERIFIED' ELSE 'FAILED' END AS status FROM chosen)"""


def transferred(t):
    i = t.inventory
    d = c("asset_id")
    m = t.manifest.select("operation_id", c("position").alias("asset_id"))
    ops = m.join(i, "asset_id").select(
        "operation_id", c("path").alias("source_path"), F.concat(F.lit("/dest"), "path").alias("dest_path"),
        F.when(d % 4 == 0, "").when(d % 13 == 0, F.reverse("sha256")).otherwise(c("sha256")).alias("expected_hash"))
    source = i.filter("asset_id % 9 <> 0")
    before = i.join(t.labels.select(c("doc_id").alias("asset_id"), "quality"), "asset_id").select(
        F.concat(F.lit("/dest"), "path").alias("path"), F.when(c("quality") == 1, c("sha256")).otherwise(F.reverse("sha256")).alias("sha256"))
    after = i.filter("asset_id % 17 <> 0").select(
        F.concat(F.lit("/dest"), "path").alias("path"), F.when(d % 19 == 0, F.reverse("sha256")).otherwise(c("sha256")).alias("sha256"))
    return J.transfer_outcome(ops, source, before, after)


@query("J25_transfer_classification", f"""
WITH {TRANSFER_SQL} SELECT operation_id, size_bytes, status, CASE WHEN status = 'FAILED' THEN 'failed' ELSE 'completed' END AS final_status, status IN ('VERIFIED', 'SKIPPED_EXISTING') AS success FROM moved""")
def transfer_classification(t):
    return transferred(t).select("operation_id", "size_bytes", "status", "final_status", "success")


# --- sets --------------------------------------------------------------------------

@query("U1_set_difference", "SELECT catalog_file_path AS path FROM catalog_assets EXCEPT SELECT path FROM inventory")
def set_difference(t):
    return U.difference(t.catalog_assets.select(c("catalog_file_path").alias("path")), t.inventory.select("path"))


@query("U2_set_intersection", "SELECT catalog_file_path AS path FROM catalog_assets INTERSECT SELECT path FROM inventory")
def set_intersection(t):
    return U.intersection(t.catalog_assets.select(c("catalog_file_path").alias("path")), t.inventory.select("path"))


@query("U3_union_of_roots", "SELECT catalog_file_path AS path FROM catalog_assets UNION SELECT path FROM inventory")
def union_of_roots(t):
    return U.union_set([t.catalog_assets.select(c("catalog_file_path").alias("path")), t.inventory.select("path")])


@query("U4_union_of_metrics", """
SELECT 'files' AS metric, count(*) AS value FROM inventory UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'images', count(*) FROM cat_images""")
def union_of_metrics(t):
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(k).alias("metric"), "value") for k, df in (("files", t.inventory), ("labels", t.labels), ("images", t.cat_images))]
    return U.union_rows(parts)
