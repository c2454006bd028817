"""Round trips through the sources and sinks: the inventory is written by a sink below the
shared folder and read back by the matching source."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.operators.joins import compare_backup
from assetlake.plans import transfer as X
from assetlake.session import scratch_path
from assetlake.sources import readers as S
from assetlake.sources import writers as Z
from assetlake.streaming.intake import current_inventory, start_intake
from assetlake.streaming.run import drain_append
from assetlake.workload.join_queries import COMPARED_SQL, backup_sides, transferred, TRANSFER_SQL
from assetlake.workload.registry import query
from assetlake.workload.views import AS_OF

c = F.col
NOW = "2024-01-15T00:00:00"

_AUDIT_SQL = """SELECT path, size_bytes, sha256, nullif(date_taken, '') AS date_taken, camera_model, CAST(CASE WHEN duration IS NOT NULL THEN 12.5 END AS DOUBLE) AS duration, width FROM inventory"""
_AUDIT = ["path", "size_bytes", "sha256", "date_taken", "camera_model", "duration", "width"]


@query("Z1_audit_csv_round_trip", _AUDIT_SQL)
def audit_csv(t):
    """S4 and Z1: images and videos with different columns in one CSV, and back."""
    out = scratch_path(t.spark, "audit") + ".csv"
    files = t.inventory.drop("asset_id", "source", "folder")
    videos = files.filter("file_type = 'VIDEO'").drop("camera_make")
    others = files.filter("file_type <> 'VIDEO'").drop("duration", "codec")
    Z.write_audit_csv([videos, others], out)
    return S.load_audit(t.spark, out).select(*_AUDIT)


@query("S5_audit_json", _AUDIT_SQL)
def audit_json(t):
    """S5: audit documents with nested file records, one per source and thousand files."""
    out = scratch_path(t.spark, "audit") + ".json"
    files = t.inventory.withColumn("part", F.floor(c("asset_id") / 1000))
    cols = [x for x in files.columns if x not in ("part", "asset_id", "source", "folder")]
    docs = files.groupBy("part").agg(F.collect_list(F.struct(*cols)).alias("file_records"))
    docs.select(F.to_json(F.struct("file_records")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(out)
    return S.load_audit(t.spark, out).select(*_AUDIT)


@query("Z2_summary_json_round_trip", "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inventory")
def summary_json(t):
    from assetlake.operators.aggregates import count_and_size

    out = scratch_path(t.spark, "summary")
    Z.write_summary(count_and_size(t.inventory), out)
    return t.spark.read.schema("files long, bytes long").json(out)


@query("Z3_review_plan_csv", """
WITH g AS (SELECT sha256, min(path) AS first_path FROM inventory GROUP BY sha256 HAVING count(*) > 1)
SELECT CASE WHEN f.path = g.first_path THEN 'KEEP' ELSE 'REVIEW' END AS action, f.path, f.size_bytes FROM inventory f JOIN g ON g.sha256 = f.sha256""")
def review_csv(t):
    from assetlake.operators.duplicates import review_plan

    out = scratch_path(t.spark, "review")
    Z.write_csv(review_plan(t.inventory.select("path", "sha256", "size_bytes")), out)
    return t.spark.read.schema("action string, path string, reason string, size_bytes long, in_catalog boolean, duplicate_group string").csv(
        out, header=True, escape='"').select("action", "path", "size_bytes")


@query("Z4_keep_delete_csv", """
SELECT keep_path, path AS delete_path, size_bytes FROM (SELECT path, size_bytes, first_value(path) OVER w AS keep_path, row_number() OVER w AS rn FROM inventory WINDOW w AS (PARTITION BY sha256 ORDER BY length(path), path)) WHERE rn > 1""")
def keep_delete_csv(t):
    from assetlake.operators.duplicates import keep_delete_pairs, recommendations

    out = scratch_path(t.spark, "pairs")
    Z.write_csv(keep_delete_pairs(recommendations(t.inventory)), out)
    return t.spark.read.schema("keep_path string, delete_path string, hash string, size_bytes long, reason string").csv(out, header=True, escape='"').select(
        "keep_path", "delete_path", "size_bytes")


_OPS_SQL = """SELECT 'OP_20240115_000000_' || printf('%04d', row_number() OVER (ORDER BY original_path)) AS operation_id, original_path, new_path, 'pending' AS status FROM manifest"""


def _operations(t):
    return X.operation_manifest(t.manifest.select(c("original_path").alias("old_path"), "new_path"), "20240115_000000", NOW, None)


@query("Z5_manifest_lines", _OPS_SQL)
def manifest_lines(t):
    out = scratch_path(t.spark, "operations")
    Z.write_operations(_operations(t), out)
    return S.read_operations(t.spark, out).select("operation_id", "original_path", "new_path", "status")


@query("S6_manifest_documents", _OPS_SQL)
def manifest_documents(t):
    """S6 and Z5: nested manifest documents, and back."""
    out = scratch_path(t.spark, "manifests")
    docs = Z.manifest_documents(_operations(t), "test", NOW)
    docs.select("document").repartition("document").write.option("maxRecordsPerFile", 1).text(out)
    return S.read_manifest(t.spark, out).select("operation_id", "original_path", "new_path", "status")


@query("Z6_checkpoint_records", """
SELECT 'CP_OP_20240115_000000_' || printf('%04d', row_number() OVER (ORDER BY original_path)) AS checkpoint_id, 'r1' AS run, original_path FROM manifest""")
def checkpoint_records(t):
    out = scratch_path(t.spark, "checkpoints")
    Z.write_checkpoints(X.checkpoint_records(_operations(t), "TASK_1", NOW), out, "r1")
    return t.spark.read.schema("checkpoint_id string, original_path string, run string").json(out).select("checkpoint_id", "run", "original_path")


@query("Z7_sidecars", "SELECT path, 'sha256:' || sha256 AS unique_id FROM inventory")
def sidecars(t):
    out = scratch_path(t.spark, "sidecars")
    ops = t.manifest.join(t.inventory.select(c("asset_id").alias("position"), "path", "filename"), "position").select(
        "operation_id", c("path").alias("original_path"), c("filename").alias("new_filename"))
    Z.write_sidecars(X.sidecars(ops, t.inventory, F.lit(AS_OF).cast("timestamp")), out, 16)
    return t.spark.read.schema("original_path string, unique_id string").json(out).select(c("original_path").alias("path"), "unique_id")


@query("Z7_second_sidecar_form", """
SELECT path, 'SC_' || printf('%05d', row_number() OVER (ORDER BY path)) AS sidecar_id, sha256 AS hash, size_bytes AS size FROM inventory""")
def second_sidecars(t):
    plan = t.inventory.select(c("path").alias("old_path"), c("path").alias("new_path"))
    docs = X.planned_sidecars(plan, t.inventory, F.lit(AS_OF).cast("timestamp"))
    s = F.from_json("sidecar", "sidecar_id string, original struct<hash:string, size:long>")
    return docs.select("path", s.alias("s")).select("path", "s.sidecar_id", "s.original.hash", "s.original.size")


@query("Z8_json_validity", """SELECT count(*) AS documents, count(*) FILTER (NOT json_valid(coalesce(metadata_json, ''))) AS invalid FROM task_log""")
def json_validity(t):
    out = scratch_path(t.spark, "json")
    t.task_log.select(F.coalesce("metadata_json", F.lit("")).alias("value")).write.text(out)
    return Z.json_validity(t.spark, out)


@query("Z9_missing_path_list", f"WITH {COMPARED_SQL} SELECT rel_path AS path FROM cmp WHERE outcome = 'missing'")
def path_list(t):
    out = scratch_path(t.spark, "missing")
    Z.write_paths(compare_backup(*backup_sides(t)).filter("outcome = 'missing'"), out, "rel_path")
    return t.spark.read.text(out).select(c("value").alias("path"))


@query("Z10_mismatch_csv", f"WITH {COMPARED_SQL} SELECT rel_path, primary_hash FROM cmp WHERE outcome = 'mismatch'")
def mismatch_csv(t):
    out = scratch_path(t.spark, "mismatch")
    Z.write_csv(compare_backup(*backup_sides(t)).filter("outcome = 'mismatch'").select("rel_path", "primary_hash", "backup_hash"), out)
    return t.spark.read.schema("rel_path string, primary_hash string, backup_hash string").csv(out, header=True).select("rel_path", "primary_hash")


@query("Z11_ingestion_index", "SELECT o_orderstatus AS status, count(*) AS runs FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1")
def ingestion_index(t):
    out = scratch_path(t.spark, "index")
    Z.append_rows(t.orders.select(c("o_orderstatus").alias("status")), out)
    Z.append_rows(t.lineitem.select(c("l_returnflag").alias("status")), out)
    return t.spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("runs"))


@query("Z12_transfer_log", f"WITH {TRANSFER_SQL} SELECT status, count(*) AS rows, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM moved GROUP BY status")
def transfer_log(t):
    out = scratch_path(t.spark, "transfer-log")
    Z.append_rows(Z.transfer_log_rows(transferred(t), NOW), out)
    return t.spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("rows"), F.sum("size_bytes").alias("bytes"))


_SCAN_SQL = """SELECT source, CAST(sum(strlen(path) + 1) AS BIGINT) AS bytes FROM inventory GROUP BY source"""


def _folder(t, name):
    """The inventory's paths as text files in one folder per source."""
    out = scratch_path(t.spark, name)
    t.inventory.select(c("path").alias("value"), "source").write.partitionBy("source").text(out)
    return out


def _by_source(files):
    return files.groupBy(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source")).agg(F.sum("size_bytes").alias("bytes"))


@query("S1_file_scan", _SCAN_SQL)
def file_scan(t):
    return _by_source(S.scan_files(t.spark, _folder(t, "scan")))


@query("S2_scan_by_suffix", _SCAN_SQL)
def scan_by_suffix(t):
    """Suffixes in any case; the other files of the folder are left out."""
    out = _folder(t, "suffix")
    t.labels.write.mode("append").json(f"{out}/source=other")
    return _by_source(S.scan_files(t.spark, out, suffixes=[".TXT"]))


@query("S3_scan_of_several_roots", """
SELECT 0 AS folder_index, CAST(sum(strlen(path) + 1) AS BIGINT) AS bytes FROM inventory UNION ALL SELECT 2, CAST(sum(strlen(url) + 1) AS BIGINT) FROM pages UNION ALL SELECT -1, 1""")
def scan_roots(t):
    """Root 1 does not exist and is reported, as index -1 here."""
    one, two = _folder(t, "root"), scratch_path(t.spark, "root")
    t.pages.select(c("url").alias("value")).write.text(two)
    files, errors = S.scan_roots(t.spark, [one, f"{one}-missing", two], suffixes=[".txt"])
    found = files.groupBy("folder_index").agg(F.sum("size_bytes").alias("bytes"))
    return found.unionByName(errors.agg(F.count("*").alias("bytes")).select(F.lit(-1).alias("folder_index"), "bytes"))


@query("M1_hashed_folder", """
SELECT source, md5(body) AS md5, sha256(body) AS sha256, CAST(NULL AS VARCHAR) AS error
FROM (SELECT source, string_agg(path, chr(10) ORDER BY path) || chr(10) AS body FROM inventory GROUP BY source)""")
def hashed_folder(t):
    """One file per source, whose lines are its paths in order."""
    out = scratch_path(t.spark, "hash")
    t.inventory.select(c("path").alias("value"), "source").repartition("source").sortWithinPartitions("source", "value").write.partitionBy("source").text(out)
    files = S.hash_files(t.spark, out).filter(c("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), "md5", "sha256", "error")


@query("S4_audit_csv_scan", _AUDIT_SQL)
def audit_csv_scan(t):
    out = scratch_path(t.spark, "audit-csv")
    Z.write_csv(t.inventory.select(*_AUDIT), out)
    return S.read_audit_csv(t.spark, out).select(*_AUDIT)


@query("S7_newest_checkpoint", """
SELECT arg_max(operation_id, position) AS last_completed_op_id, max(position) AS last_completed_index, count(*) AS success_count FROM manifest WHERE status = 'completed'""")
def newest_checkpoint(t):
    """Checkpoints of every thousand operations, then that of the whole run, in one folder."""
    out = scratch_path(t.spark, "states")
    done = t.manifest.filter("status = 'completed'")
    state = (F.max_by("operation_id", "position").alias("last_completed_op_id"), F.max("position").alias("last_completed_index"), F.count("*").alias("success_count"))
    for df in (done.groupBy(F.floor(c("position") / 1000).alias("part")).agg(*state).drop("part"), done.agg(*state)):
        docs = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        docs.write.mode("append").option("maxRecordsPerFile", 1).text(out)
    return S.newest_checkpoint(t.spark, out).select("last_completed_op_id", "last_completed_index", "success_count")


@query("S12_watched_folder_stream", _SCAN_SQL)
def watched_folder(t):
    return _by_source(drain_append(S.watch_folder(t.spark, _folder(t, "watch"), [".txt"]), "watched"))


@query("R7_file_intake_stream", _SCAN_SQL)
def file_intake(t):
    table = scratch_path(t.spark, "intake")
    start_intake(S.watch_folder(t.spark, _folder(t, "incoming"), [".txt"]), table, f"{table}-checkpoint").awaitTermination()
    return _by_source(current_inventory(t.spark.read.parquet(table)))


@query("S8_tables_by_sql", "SELECT file_type, count(*) AS files FROM assets GROUP BY file_type HAVING count(*) > 1")
def tables_by_sql(t):
    """S8: the library's tables under their names in SQL."""
    out = scratch_path(t.spark, "library")
    t.assets.write.parquet(f"{out}/library_assets")
    S.register_tables(t.spark, out, ["library_assets"])
    return t.spark.sql("select file_type, count(*) as files from library_assets group by file_type having count(*) > 1")


@query("S9_catalog_tables", "SELECT 'main' AS catalog_path, count(*) AS images FROM cat_images UNION ALL SELECT 'second', count(*) FROM cat_files")
def catalog_tables(t):
    """S9: one table of two catalogs."""
    out = scratch_path(t.spark, "catalogs")
    t.cat_images.select("id").write.parquet(f"{out}/a/images")
    t.cat_files.select("id").write.parquet(f"{out}/b/images")
    both = S.read_catalogs(t.spark, {"main": f"{out}/a", "second": f"{out}/b"}, "images")
    return both.groupBy("catalog_path").agg(F.count("*").alias("images"))
