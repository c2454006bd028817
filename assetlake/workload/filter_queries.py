"""Queries for filters and data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import names as N
from assetlake.functions import paths as P
from assetlake.operators import filters as X
from assetlake.operators import quality as V
from assetlake.session import scratch_path
from assetlake.sources import search as I
from assetlake.sources import tables as K
from assetlake.workload.registry import query

c = F.col


@query("F1_media_class", "SELECT path, file_type FROM inventory")
def media_class(t):
    return t.inventory.select("path", P.media_class(P.suffix(c("path"))).alias("file_type"))


@query("F2_asset_criteria", """
SELECT id, file_path, file_size_bytes FROM assets WHERE camera_model = 'D750' AND ingested_date >= TIMESTAMP '2023-01-02' AND ingested_date <= TIMESTAMP '2023-11-30'
  AND file_size_bytes >= 500 AND file_size_bytes <= 50000 AND filename ILIKE '%img\\_%' ESCAPE '\\'""")
def asset_criteria(t):
    f = X.AssetFilter(camera="D750", date_from="2023-01-02", date_to="2023-11-30", size_min=500, size_max=50000, name_contains="img_")
    return X.filter_assets(t.assets, f, date="ingested_date", size="file_size_bytes", path="file_path").select("id", "file_path", "file_size_bytes")


@query("F3_text_search", "SELECT id, file_path FROM assets WHERE lower(filename) LIKE '%d75%' OR lower(file_path) LIKE '%d75%' OR lower(coalesce(camera_model, '')) LIKE '%d75%'")
def text_search(t):
    return t.assets.filter(X.search_text("D75", "filename", "file_path", "camera_model")).select("id", "file_path")


@query("F3_text_search_by_trigrams", "SELECT id, file_path FROM assets WHERE lower(filename) LIKE '%c3/en%' OR lower(file_path) LIKE '%c3/en%' OR lower(coalesce(camera_model, '')) LIKE '%c3/en%'")
def text_search_by_trigrams(t):
    path, names = scratch_path(t.spark, "searchable"), ["filename", "file_path", "camera_model"]
    I.write_searchable(t.assets.select("id", *names), path, names, "file_path")
    return I.search(t.spark, path, "C3/EN", names).select("id", "file_path")


@query("F4_asset_type", "SELECT id, file_path FROM assets WHERE file_type = 'RAW'")
def asset_type(t):
    return X.filter_assets(t.assets, X.AssetFilter(kind="RAW"), path="file_path").select("id", "file_path")


@query("F5_status_set", "SELECT task_id, status FROM task_log WHERE status IN ('STARTING', 'RUNNING', 'PAUSED')")
def status_set(t):
    return X.with_status(t.task_log).select("task_id", "status")


@query("F6_completed_operations", "SELECT operation_id, new_path FROM manifest WHERE status = 'completed'")
def completed_operations(t):
    return X.with_status(t.manifest, ["completed"]).select("operation_id", "new_path")


@query("F7_missing_metadata", """
SELECT path, file_type FROM inventory WHERE (file_type = 'IMAGE' AND date_taken = '' AND camera_make IS NULL AND camera_model IS NULL)
  OR (file_type = 'VIDEO' AND duration IS NULL AND codec IS NULL)""")
def missing_metadata(t):
    return X.missing_metadata(t.inventory).select("path", "file_type")


@query("F8_age_window", """
SELECT operation_id, "timestamp" FROM manifest WHERE "timestamp" >= '2023-01-15T00:00:00'""")
def age_window(t):
    return X.newer_than(t.manifest, "2023-01-16 00:00:00", 24).select("operation_id", "timestamp")


@query("F9_date_between", "SELECT id, file_path FROM assets WHERE ingested_date BETWEEN TIMESTAMP '2023-02-01' AND TIMESTAMP '2023-06-30'")
def date_between(t):
    return X.between(t.assets, "ingested_date", F.lit("2023-02-01").cast("timestamp"), F.lit("2023-06-30").cast("timestamp")).select("id", "file_path")


def _by_month(t):
    path = scratch_path(t.spark, "assets")
    K.write_by_month(t.assets.select("id", "file_path", "ingested_date"), path)
    return path


@query("F9_date_between_by_month", "SELECT id, file_path FROM assets WHERE ingested_date BETWEEN TIMESTAMP '2023-02-11' AND TIMESTAMP '2023-06-30'")
def date_between_by_month(t):
    return K.read_by_month(t.spark, _by_month(t), "2023-02-11", "2023-06-30").select("id", "file_path")


@query("F10_excluded_patterns", "SELECT id, file_path FROM assets WHERE file_path NOT LIKE '%/fr/%' AND file_path NOT LIKE '%/de/%'")
def excluded_patterns(t):
    return X.not_like(t.assets, "file_path", ["%/fr/%", "%/de/%"]).select("id", "file_path")


@query("F11_path_prefix", "SELECT id, file_path FROM assets WHERE starts_with(file_path, '/src1/')")
def path_prefix(t):
    return X.under(t.assets, "file_path", "/src1/").select("id", "file_path")


@query("F11_path_prefix_by_month", "SELECT id, file_path FROM assets WHERE starts_with(file_path, '/src1/') AND ingested_date >= TIMESTAMP '2023-05-01'")
def path_prefix_by_month(t):
    return X.under(K.read_by_month(t.spark, _by_month(t), "2023-05-01"), "file_path", "/src1/").select("id", "file_path")


@query("F12_point_lookup", "SELECT id, file_path FROM assets WHERE sha256_hash = (SELECT min(sha256_hash) FROM assets) OR camera_model = 'EOS R5'")
def point_lookup(t):
    least = t.assets.select(F.min("sha256_hash")).scalar()
    return t.assets.filter((c("sha256_hash") == least) | (c("camera_model") == "EOS R5")).select("id", "file_path")


@query("F13_include_exclude_globs", """
SELECT path FROM inventory WHERE extension IN ('.nef', '.jpg', '.cr2', '.mp4', '.mov') AND source <> 'src1' AND source NOT LIKE 'src1%'""")
def include_exclude(t):
    return t.inventory.filter(P.selected(c("path"), C.BACKUP_INCLUDE, [*C.BACKUP_EXCLUDE, "/src1*/**/*"])).select("path")


@query("F14_pattern_by_path_words", """
SELECT p_partkey, CASE WHEN regexp_matches(lower(p), 'wedding|marriage') THEN '{YYYY}-{MM}-{DD}_{couple_names}_{camera_model}_{sequence}'
  WHEN regexp_matches(lower(p), 'real_estate|property|listing') THEN '{YYYY}-{MM}-{DD}_{property_address}_{sequence}'
  WHEN regexp_matches(lower(p), 'product|ecommerce|shop') THEN '{YYYY}-{MM}-{DD}_{product_sku}_{sequence}'
  ELSE '{YYYY}-{MM}-{DD}_{HH}-{MM}-{SS}_{camera_model}_{sequence}' END AS pattern
FROM (SELECT p_partkey, '/x/' || CASE p_size % 5 WHEN 0 THEN 'Wedding' WHEN 1 THEN 'Listing' WHEN 2 THEN 'SHOP' ELSE p_name END AS p FROM part)""")
def pattern_by_words(t):
    s = c("p_size") % 5
    p = F.concat(F.lit("/x/"), F.when(s == 0, "Wedding").when(s == 1, "Listing").when(s == 2, "SHOP").otherwise(c("p_name")))
    return t.part.select("p_partkey", N.naming_pattern(p).alias("pattern"))


@query("F15_edited_images", "SELECT id, exposure FROM cat_develop WHERE exposure IS NOT NULL OR cropTop IS NOT NULL")
def edited_images(t):
    return X.edited_images(t.cat_develop).select("id", "exposure")


# --- data quality ------------------------------------------------------------------

@query("V1_value_rules", """
SELECT l_key, "column", value FROM (
  SELECT l_orderkey * 10 + l_linenumber AS l_key, 'transfer_status' AS "column", s AS value FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'lost' WHEN 'N' THEN 'completed' END AS s FROM lineitem) WHERE s NOT IN ('pending', 'in_progress', 'completed', 'failed', 'retry')
  UNION ALL
  SELECT l_orderkey * 10 + l_linenumber, 'rating', CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber NOT BETWEEN 0 AND 5)""")
def value_rules(t):
    rows = t.lineitem.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("l_key"), F.when(c("l_returnflag") == "A", "lost").when(c("l_returnflag") == "N", "completed").alias("transfer_status"),
        c("l_linenumber").alias("rating"))
    return V.table_violations(rows, "transfers", "l_key")


@query("V2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(t):
    return V.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("V3_orphan_rows", """
SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT asset_id FROM inventory WHERE camera_make IS NOT NULL)""")
def orphan_rows(t):
    return V.orphans(t.labels.select("doc_id", "quality"), t.inventory.filter("camera_make is not null"), "doc_id", "asset_id")


@query("V3_cascade_delete", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT asset_id FROM inventory WHERE camera_make IS NOT NULL)")
def cascade(t):
    return V.cascade_delete(t.labels.select("doc_id", "quality"), t.inventory.filter("camera_make is not null"), "doc_id", "asset_id")


@query("V3_set_null_on_delete", """
SELECT o.o_orderkey, coalesce(c.c_custkey, -1) AS o_custkey FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""")
def set_null(t):
    out = V.set_null_on_delete(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey")
    return out.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


@query("V4_date_drift", """
SELECT asset_id, taken_ts IS NOT NULL AND abs(epoch(modified_ts) - epoch(taken_ts)) <= 7200 AS valid,
  CASE WHEN taken_ts IS NULL THEN 'use_file_mtime' WHEN abs(epoch(modified_ts) - epoch(taken_ts)) > 7200 THEN 'flag_for_review' ELSE 'use_exif_date' END AS action,
  CASE WHEN taken_ts IS NULL THEN 'No EXIF date' WHEN abs(epoch(modified_ts) - epoch(taken_ts)) > 7200 THEN 'Timezone drift detected (' || printf('%.1f', abs(epoch(modified_ts) - epoch(taken_ts)) / 3600) || ' hours)' END AS reason
FROM inventory""")
def date_drift(t):
    from assetlake.functions import dates as D

    rows = t.inventory.select("asset_id", D.parse_taken(c("date_taken")).alias("taken"), D.parse_taken(c("modified")).alias("mtime"))
    return V.date_drift(rows, "taken", "mtime").select("asset_id", "valid", "action", "reason")


@query("V5_already_ingested_share", """
SELECT n AS files, k AS already, k / greatest(n, 1) AS share, CASE WHEN n > 0 AND k = n THEN 'skip' WHEN k / greatest(n, 1) >= 0.5 THEN 'prompt' ELSE 'continue' END AS verdict
FROM (SELECT count(*) AS n, count(CASE WHEN sha256 IN (SELECT sha256 FROM catalog_assets) THEN 1 END) AS k FROM inventory)""")
def ingested_share(t):
    return V.ingested_share(t.inventory, t.catalog_assets)


@query("V6_drive_already_ingested", "SELECT count(*) AS times FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderstatus = 'F'")
def drive_ingested(t):
    least = t.orders.select(F.min("o_custkey")).scalar()
    runs = t.orders.select(c("o_custkey").alias("drive_hash"), F.when(c("o_orderstatus") == "F", "completed").otherwise("failed").alias("transfer_status"))
    return V.completed_transfers(runs, least)
