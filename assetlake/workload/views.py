"""The given tables seen as a file library: plain projections in Spark and the same in SQL.

``documents`` plays the files, ``labels`` the backup and catalog records, ``embeddings`` the
perceptual hashes, ``events`` the heartbeats and sensor readings, ``orders`` the task log,
``lineitem`` the transfer log, and ``region``/``nation``/``customer`` a catalog's root folders,
folders and files.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions import hashes as H
from assetlake.functions import names as N
from assetlake.functions import paths as P

EPOCH = 1672531200  # 2023-01-01 00:00:00 UTC
YEAR_SECONDS = 31536000
AS_OF = "2024-01-15 00:00:00"


class Tables:
    """Lazy access to the tables of one folder and to the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def inventory(self) -> DataFrame:
        """One row per file, with times, hashes, camera and video columns."""
        d, pos = F.col("doc_id"), F.floor(F.col("doc_id") / 20) % 2
        lang = F.col("lang")
        ext = (
            F.when(lang == "en", F.when(pos == 0, ".NEF").otherwise(".jpg"))
            .when(lang == "fr", F.when(pos == 0, ".JPG").otherwise(".cr2"))
            .when(lang == "de", F.when(pos == 0, ".mp4").otherwise(".mov"))
            .otherwise(F.when(pos == 0, ".txt").otherwise(".pdf"))
        )
        path = F.concat(
            F.lit("/"), F.col("source"), F.lit("/"), lang, F.lit("/IMG_"),
            F.format_string("%06d", F.floor(d / 40)), ext,
        )
        second = (F.floor(d / 4) * 104729) % YEAR_SECONDS + d % 4
        taken = F.timestamp_seconds(EPOCH + second)
        modified = F.timestamp_seconds(EPOCH + second + (d % 5) * 3600 - 3600)
        cam = F.floor(d / 20) % 5
        video = (lang == "de") & (d % 3 != 0)
        base = self.read("documents").select(
            d.alias("asset_id"), path.alias("path"), F.col("n_chars").cast("long").alias("size_bytes"),
            F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
            F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
            F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"),
            F.when(d % 3 == 0, F.date_format(taken, "yyyy:MM:dd HH:mm:ss"))
            .when(d % 3 == 1, F.date_format(taken, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("").alias("date_taken"),
            F.when(cam == 0, "NIKON").when(cam == 1, "Sony").when(cam == 2, "Canon").when(cam == 3, "Acme").alias("camera_make"),
            F.when(cam == 0, "D750").when(cam == 1, "ILCE-7M3").when(cam == 2, "EOS R5").when(cam == 3, "Model X9").alias("camera_model"),
            F.when(video, "12.5").alias("duration"), F.when(video, "h264").alias("codec"),
            (640 * (1 + d % 4)).cast("int").alias("width"), (360 * (1 + d % 4)).cast("int").alias("height"),
            F.col("source"),
        )
        p = F.col("path")
        return base.select(
            "*", P.name(p).alias("filename"), P.suffix_lower(p).alias("extension"),
            P.media_class(P.suffix(p)).alias("file_type"), P.parent(p).alias("folder"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        """Asset records keyed by id."""
        i = F.col("asset_id")
        kind = (
            F.when(F.col("extension").isin(".nef", ".cr2"), "RAW").when(F.col("extension") == ".jpg", "JPG")
            .when(F.col("extension").isin(".mp4", ".mov"), "VIDEO").otherwise("OTHER")
        )
        return self.inventory.select(
            i.alias("id"), F.col("path").alias("file_path"), "filename", kind.alias("file_type"),
            F.col("size_bytes").alias("file_size_bytes"), F.col("sha256").alias("sha256_hash"),
            F.timestamp_seconds(EPOCH + (F.floor(i / 4) * 104729) % YEAR_SECONDS + i % 4).alias("date_taken"),
            "camera_model", (i % 6).cast("int").alias("lightroom_rating"),
            (i % 7 == 0).alias("is_duplicate"), (i % 11 == 0).alias("is_missing"),
            F.timestamp_seconds(EPOCH + (i * 7919) % YEAR_SECONDS).alias("ingested_date"),
        )

    @cached_property
    def backups(self) -> DataFrame:
        """Backup records; some assets have two."""
        lab = self.read("labels")
        first = lab.select(
            F.col("doc_id").alias("asset_id"), F.when(F.col("toxic") == 1, "r2").otherwise("local").alias("backup_location"),
            F.when(F.col("quality") == 1, "backed_up").otherwise("failed").alias("backup_status"),
            F.timestamp_seconds(EPOCH + F.col("doc_id") * 3607).alias("last_backup_at"),
        )
        second = lab.filter("quality = 0").select(
            F.col("doc_id").alias("asset_id"), F.lit("nas").alias("backup_location"),
            F.lit("pending").alias("backup_status"),
            F.timestamp_seconds(EPOCH + F.col("doc_id") * 3607 + 60).alias("last_backup_at"),
        )
        return first.unionByName(second)

    @cached_property
    def catalog_assets(self) -> DataFrame:
        """Catalog entries: labelled files with a good label; a missing one points elsewhere."""
        return (
            self.read("labels").filter("quality = 1").select(F.col("doc_id").alias("asset_id"))
            .join(self.inventory.select("asset_id", "path", "sha256"), "asset_id")
            .select(
                "asset_id", "sha256", (F.col("asset_id") % 5 == 0).alias("is_missing"),
                F.when(F.col("asset_id") % 5 == 0, F.concat(F.lit("/old"), F.col("path"))).otherwise(F.col("path")).alias("catalog_file_path"),
                (F.col("asset_id") % 6).cast("int").alias("rating"), (F.col("asset_id") % 3 - 1).cast("int").alias("pick_flag"),
            )
        )

    @cached_property
    def drives(self) -> DataFrame:
        """One drive per source folder."""
        return self.read("documents").groupBy("source").agg(F.count("*").alias("n")).select(
            F.concat(F.lit("SN-"), "source").alias("serial_number"), F.concat(F.lit("/"), "source").alias("mount_path"),
            F.concat(F.lit("drive "), "source").alias("nickname"), (F.col("n") * 4000).alias("capacity_bytes"),
        )

    @cached_property
    def manifest(self) -> DataFrame:
        """Planned operations over the files, in all states."""
        d = F.col("asset_id")
        return self.inventory.select(
            N.operation_id("20240101_000000", d + 1).alias("operation_id"), d.alias("position"),
            F.concat(F.lit("/in"), F.col("path")).alias("original_path"),
            F.when(d % 9 == 0, F.concat(F.col("path"), F.lit(".gone"))).otherwise(F.col("path")).alias("new_path"),
            F.when(d % 8 == 0, "").otherwise(F.col("sha256")).alias("hash_before"),
            F.when(d % 4 == 0, "").when(d % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("hash_after"),
            F.date_format(F.timestamp_seconds(EPOCH + (d * 7919) % YEAR_SECONDS), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.when(d % 10 == 0, "failed").when(d % 10 == 1, "pending").when(d % 10 == 2, "rolled_back")
            .otherwise("completed").alias("status"),
            F.col("size_bytes").alias("file_size"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        """Transfer log rows."""
        return self.read("lineitem").select(
            F.col("l_returnflag").alias("session"), (F.col("l_quantity") * 1000).cast("long").alias("size_bytes"),
            F.when(F.col("l_linestatus") == "F", "VERIFIED")
            .when(F.col("l_linenumber") % 3 == 0, "SKIPPED").when(F.col("l_linenumber") % 3 == 1, "SKIPPED_EXISTING")
            .otherwise("FAILED").alias("status"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Sensor readings per drive."""
        return self.read("events").select(
            F.col("event_id"), F.col("user_id").alias("drive"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("temperature"),
        )

    @cached_property
    def heartbeats(self) -> DataFrame:
        """Heartbeats per task."""
        return self.read("events").select(
            F.col("event_id"), F.format_string("TASK_20240101_%04d", "user_id").alias("task_id"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status_message"),
            F.col("value").alias("progress_pct"), F.col("props").alias("metadata_json"),
        )

    @cached_property
    def task_log(self) -> DataFrame:
        """Task log, one row per task."""
        k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        return self.read("orders").select(
            F.concat(F.lit("TASK_"), F.date_format(start, "yyyyMMdd"), F.lit("_"), F.format_string("%04d", k)).alias("task_id"),
            F.element_at(F.split("o_orderpriority", "-"), 2).alias("task_type"),
            F.when(F.col("o_orderstatus") == "F", "RUNNING").when(F.col("o_orderstatus") == "O", "COMPLETED")
            .when(k % 2 == 0, "PAUSED").otherwise("FAILED").alias("status"),
            (k % 101).cast("double").alias("progress_pct"), start.alias("started_at"),
            F.when(~F.col("o_orderpriority").startswith("4"), start + F.make_dt_interval(secs=(k % 600).cast("decimal(18,6)"))).alias("last_heartbeat"),
            F.when(k % 3 == 0, F.lit("not json")).when(k % 3 == 1, F.format_string('{"file":"f%d"}', k)).alias("metadata_json"),
        )

    @cached_property
    def picture_hashes(self) -> DataFrame:
        """Perceptual hash per picture: average hash of its 64 values."""
        return self.read("embeddings").select(
            F.format_string("/pictures/%06d.jpg", "vec_id").alias("path"), F.col("vec_id").alias("size_bytes"),
            F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), F.lit(0).alias("folder_index"),
            H.average_hash(F.col("embedding")).alias("phash"),
        )

    # A catalog: regions are root folders, nations folders and keywords, customers files and images.
    @cached_property
    def cat_roots(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("/"), "r_name").alias("absolutePath"))

    @cached_property
    def cat_folders(self) -> DataFrame:
        return self.read("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("id_root"),
            F.concat(F.lit("/"), "n_name", F.lit("/")).alias("pathFromRoot"),
        )

    @cached_property
    def cat_files(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("id_folder"), F.col("c_name").alias("baseName"),
            F.when(F.col("c_mktsegment") == "BUILDING", "NEF").otherwise("JPG").alias("extension"),
        )

    @cached_property
    def cat_images(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(
            k.alias("id"), k.alias("id_file"), F.when(k % 7 != 6, (k % 7).cast("int")).alias("rating"),
            (k % 3 - 1).cast("int").alias("pickFlags"),
            F.timestamp_seconds(EPOCH + (k * 7919) % YEAR_SECONDS).alias("captureTime"),
        )

    @cached_property
    def cat_develop(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").filter("c_acctbal > 0").select(
            k.alias("id"), F.when(k % 4 == 0, F.col("c_acctbal")).alias("exposure"),
            F.when(k % 6 == 0, F.lit(0.1)).alias("cropTop"), F.lit("11.0").alias("processVersion"),
        )

    @cached_property
    def cat_keywords(self) -> DataFrame:
        """Keyword tree: regions above nations."""
        top = self.read("region").select(
            (F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent"),
        )
        low = self.read("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"),
        )
        return top.unionByName(low)

    @cached_property
    def cat_keyword_images(self) -> DataFrame:
        return self.read("customer").filter("c_mktsegment <> 'BUILDING'").select(
            F.col("c_nationkey").cast("long").alias("id_keyword"), F.col("c_custkey").alias("id_image"),
        )


# The same views for the SQL engine, by name; a view may use earlier ones.
SQL_VIEWS = {
    "inv0": """
SELECT doc_id AS asset_id,
  '/' || source || '/' || lang || '/IMG_' || printf('%06d', doc_id // 40) ||
  CASE lang WHEN 'en' THEN CASE WHEN (doc_id // 20) % 2 = 0 THEN '.NEF' ELSE '.jpg' END
            WHEN 'fr' THEN CASE WHEN (doc_id // 20) % 2 = 0 THEN '.JPG' ELSE '.cr2' END
            WHEN 'de' THEN CASE WHEN (doc_id // 20) % 2 = 0 THEN '.mp4' ELSE '.mov' END
            ELSE CASE WHEN (doc_id // 20) % 2 = 0 THEN '.txt' ELSE '.pdf' END END AS path,
  n_chars AS size_bytes, source, lang, md5(text) AS md5, sha256(text) AS sha256,
  TIMESTAMP '2023-01-01' + to_seconds(((doc_id // 4) * 104729) % 31536000 + doc_id % 4) AS taken_ts,
  TIMESTAMP '2023-01-01' + to_seconds(((doc_id // 4) * 104729) % 31536000 + doc_id % 4 + (doc_id % 5) * 3600 - 3600) AS modified_ts,
  (doc_id // 20) % 5 AS cam
FROM documents""",
    "inventory": """
SELECT asset_id, path, size_bytes, source, md5, sha256, modified_ts, taken_ts AS raw_taken_ts,
  CASE WHEN asset_id % 3 <> 2 THEN taken_ts END AS taken_ts,
  strftime(modified_ts, '%Y-%m-%dT%H:%M:%S') AS modified, strftime(modified_ts, '%Y-%m-%dT%H:%M:%S') AS created,
  CASE asset_id % 3 WHEN 0 THEN strftime(taken_ts, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN strftime(taken_ts, '%Y-%m-%dT%H:%M:%S') ELSE '' END AS date_taken,
  CASE cam WHEN 0 THEN 'NIKON' WHEN 1 THEN 'Sony' WHEN 2 THEN 'Canon' WHEN 3 THEN 'Acme' END AS camera_make,
  CASE cam WHEN 0 THEN 'D750' WHEN 1 THEN 'ILCE-7M3' WHEN 2 THEN 'EOS R5' WHEN 3 THEN 'Model X9' END AS camera_model,
  CASE cam WHEN 0 THEN 'D750' WHEN 1 THEN 'A7III' WHEN 2 THEN 'R5' WHEN 3 THEN 'X9' ELSE 'UNK' END AS camera_short,
  CASE WHEN lang = 'de' AND asset_id % 3 <> 0 THEN '12.5' END AS duration,
  CASE WHEN lang = 'de' AND asset_id % 3 <> 0 THEN 'h264' END AS codec,
  CAST(640 * (1 + asset_id % 4) AS INTEGER) AS width, CAST(360 * (1 + asset_id % 4) AS INTEGER) AS height,
  split_part(path, '/', 4) AS filename, lower('.' || split_part(path, '.', 2)) AS extension,
  CASE WHEN lang IN ('en', 'fr') THEN 'IMAGE' WHEN lang = 'de' THEN 'VIDEO' ELSE 'OTHER' END AS file_type,
  '/' || source || '/' || lang AS folder, split_part(split_part(path, '/', 4), '.', 1) AS stem
FROM inv0""",
    "assets": """
SELECT asset_id AS id, path AS file_path, filename,
  CASE WHEN extension IN ('.nef', '.cr2') THEN 'RAW' WHEN extension = '.jpg' THEN 'JPG' WHEN extension IN ('.mp4', '.mov') THEN 'VIDEO' ELSE 'OTHER' END AS file_type,
  size_bytes AS file_size_bytes, sha256 AS sha256_hash, raw_taken_ts AS date_taken, camera_model,
  CAST(asset_id % 6 AS INTEGER) AS lightroom_rating, asset_id % 7 = 0 AS is_duplicate, asset_id % 11 = 0 AS is_missing,
  TIMESTAMP '2023-01-01' + to_seconds((asset_id * 7919) % 31536000) AS ingested_date
FROM inventory""",
    "backups": """
SELECT doc_id AS asset_id, CASE WHEN toxic = 1 THEN 'r2' ELSE 'local' END AS backup_location,
  CASE WHEN quality = 1 THEN 'backed_up' ELSE 'failed' END AS backup_status,
  TIMESTAMP '2023-01-01' + to_seconds(doc_id * 3607) AS last_backup_at FROM labels
UNION ALL
SELECT doc_id, 'nas', 'pending', TIMESTAMP '2023-01-01' + to_seconds(doc_id * 3607 + 60) FROM labels WHERE quality = 0""",
    "catalog_assets": """
SELECT i.asset_id, i.sha256, i.asset_id % 5 = 0 AS is_missing,
  CASE WHEN i.asset_id % 5 = 0 THEN '/old' || i.path ELSE i.path END AS catalog_file_path,
  CAST(i.asset_id % 6 AS INTEGER) AS rating, CAST(i.asset_id % 3 - 1 AS INTEGER) AS pick_flag
FROM labels l JOIN inventory i ON i.asset_id = l.doc_id WHERE l.quality = 1""",
    "drives": """
SELECT 'SN-' || source AS serial_number, '/' || source AS mount_path, 'drive ' || source AS nickname,
  count(*) * 4000 AS capacity_bytes FROM documents GROUP BY source""",
    "manifest": """
SELECT 'OP_20240101_000000_' || printf('%04d', asset_id + 1) AS operation_id, asset_id AS position, '/in' || path AS original_path,
  CASE WHEN asset_id % 9 = 0 THEN path || '.gone' ELSE path END AS new_path,
  CASE WHEN asset_id % 8 = 0 THEN '' ELSE sha256 END AS hash_before,
  CASE WHEN asset_id % 4 = 0 THEN '' WHEN asset_id % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS hash_after,
  strftime(TIMESTAMP '2023-01-01' + to_seconds((asset_id * 7919) % 31536000), '%Y-%m-%dT%H:%M:%S') AS "timestamp",
  CASE asset_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'rolled_back' ELSE 'completed' END AS status,
  size_bytes AS file_size
FROM inventory""",
    "transfers": """
SELECT l_returnflag AS session, CAST(l_quantity * 1000 AS BIGINT) AS size_bytes,
  CASE WHEN l_linestatus = 'F' THEN 'VERIFIED' WHEN l_linenumber % 3 = 0 THEN 'SKIPPED' WHEN l_linenumber % 3 = 1 THEN 'SKIPPED_EXISTING' ELSE 'FAILED' END AS status,
  l_shipdate AS "timestamp" FROM lineitem""",
    "readings": "SELECT event_id, user_id AS drive, ts, value AS temperature FROM events",
    "heartbeats": """
SELECT event_id, 'TASK_20240101_' || printf('%04d', user_id) AS task_id, ts, event_type AS status_message, value AS progress_pct,
  props AS metadata_json FROM events""",
    "task_log": """
SELECT 'TASK_' || strftime(o_orderdate, '%Y%m%d') || '_' || printf('%04d', o_orderkey) AS task_id,
  split_part(o_orderpriority, '-', 2) AS task_type,
  CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' WHEN o_orderstatus = 'O' THEN 'COMPLETED' WHEN o_orderkey % 2 = 0 THEN 'PAUSED' ELSE 'FAILED' END AS status,
  CAST(o_orderkey % 101 AS DOUBLE) AS progress_pct, o_orderdate AS started_at,
  CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderdate + to_seconds(o_orderkey % 600) END AS last_heartbeat,
  CASE o_orderkey % 3 WHEN 0 THEN 'not json' WHEN 1 THEN '{"file":"f' || o_orderkey || '"}' END AS metadata_json
FROM orders""",
    "picture_bits": """
SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) > m THEN '1' ELSE '0' END), '') AS bits
FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding) AS m FROM embeddings)""",
    "picture_hashes": """
SELECT printf('/pictures/%06d.jpg', vec_id) AS path, vec_id AS size_bytes, sha256(CAST(vec_id AS VARCHAR)) AS sha256, 0 AS folder_index,
  bits, CAST(bits AS BIT) AS word,
  lower(array_to_string(list_transform(range(0, 16), lambda i: printf('%x', CAST(CAST(lpad(substr(bits, CAST(i AS BIGINT) * 4 + 1, 4), 32, '0') AS BIT) AS INTEGER))), '')) AS phash
FROM picture_bits""",
    "cat_roots": "SELECT r_regionkey AS id, '/' || r_name AS absolutePath FROM region",
    "cat_folders": "SELECT n_nationkey AS id, n_regionkey AS id_root, '/' || n_name || '/' AS pathFromRoot FROM nation",
    "cat_files": """
SELECT c_custkey AS id, c_nationkey AS id_folder, c_name AS baseName,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'NEF' ELSE 'JPG' END AS extension FROM customer""",
    "cat_images": """
SELECT c_custkey AS id, c_custkey AS id_file, CASE WHEN c_custkey % 7 <> 6 THEN CAST(c_custkey % 7 AS INTEGER) END AS rating,
  CAST(c_custkey % 3 - 1 AS INTEGER) AS pickFlags, TIMESTAMP '2023-01-01' + to_seconds((c_custkey * 7919) % 31536000) AS captureTime FROM customer""",
    "cat_develop": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS exposure, CASE WHEN c_custkey % 6 = 0 THEN CAST(0.1 AS DOUBLE) END AS cropTop,
  '11.0' AS processVersion FROM customer WHERE c_acctbal > 0""",
    "cat_keywords": """
SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey + 1000 AS BIGINT) FROM nation""",
    "cat_keyword_images": """
SELECT CAST(c_nationkey AS BIGINT) AS id_keyword, c_custkey AS id_image FROM customer WHERE c_mktsegment <> 'BUILDING'""",
}


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it names, in definition order."""
    def used(text: str) -> set[str]:
        return {v for v in SQL_VIEWS if re.search(rf"\b{v}\b", text)}

    need, todo = set(), used(sql)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo |= used(SQL_VIEWS[v]) - need
    if not need:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({body.strip()})" for v, body in SQL_VIEWS.items() if v in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
