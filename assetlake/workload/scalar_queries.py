"""Queries for string, date, number, hash and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import documents as J
from assetlake.functions import hashes as H
from assetlake.functions import measures as M
from assetlake.functions import names as N
from assetlake.functions import paths as P
from assetlake.operators import aggregates as A
from assetlake.operators.joins import catalog_images, rewrite_paths
from assetlake.operators.skew import member_lists
from assetlake.workload.registry import query
from assetlake.workload.views import AS_OF

c = F.col


# --- strings -------------------------------------------------------------------

@query("P1_path_pieces", """
SELECT path, filename AS name, stem, extension AS suffix, folder AS parent FROM inventory""")
def path_pieces(t):
    p = c("path")
    return t.inventory.select("path", P.name(p).alias("name"), P.stem(p).alias("stem"), P.suffix_lower(p).alias("suffix"), P.parent(p).alias("parent"))


@query("P2_mime_type", """
SELECT path, CASE extension WHEN '.jpg' THEN 'image/jpeg' WHEN '.mp4' THEN 'video/mp4' WHEN '.mov' THEN 'video/quicktime'
  WHEN '.txt' THEN 'text/plain' WHEN '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM inventory""")
def mime_type(t):
    return t.inventory.select("path", P.mime_type(c("path")).alias("mime"))


@query("P3_catalog_path", """
SELECT i.id, r.absolutePath || f.pathFromRoot || x.baseName || '.' || x.extension AS full_path
FROM cat_images i JOIN cat_files x ON i.id_file = x.id JOIN cat_folders f ON x.id_folder = f.id JOIN cat_roots r ON f.id_root = r.id""")
def catalog_path(t):
    return catalog_images(t.cat_images, t.cat_files, t.cat_folders, t.cat_roots).select("id", "full_path")


@query("P4_camera_short_name", "SELECT asset_id, camera_short AS camera FROM inventory")
def camera_short(t):
    return t.inventory.select("asset_id", N.camera_short(N.full_camera(c("camera_make"), c("camera_model"))).alias("camera"))


@query("P5_dated_file_name", """
SELECT asset_id, CASE WHEN file_type <> 'IMAGE' THEN 'not_photo' ELSE 'ok' END AS reason,
  strftime(coalesce(taken_ts, modified_ts), '%Y-%m-%d_%H-%M-%S') || '_' || camera_short || '_' || printf('%04d', asset_id) || extension AS new_name
FROM inventory""")
def dated_name(t):
    taken = D.first_parsed(c("date_taken"), c("modified"))
    cam = N.camera_short(N.full_camera(c("camera_make"), c("camera_model")))
    return t.inventory.select(
        "asset_id", N.rename_reason(c("extension"), taken).alias("reason"), N.dated_name(taken, cam, c("asset_id"), c("extension")).alias("new_name"))


@query("P6_template_tokens", """
SELECT asset_id, strftime(coalesce(taken_ts, modified_ts), '%Y%m%d-%H%M%S') || '_' || coalesce(replace(camera_make, ' ', '_'), 'Unknown') || '_' ||
  coalesce(replace(camera_model, ' ', '_'), 'Unknown') || '_Unknown_' || printf('%03d', asset_id) || '_' || stem || '_0_0' ||
  regexp_extract(path, '\\.[^.]+$') AS new_name
FROM inventory""")
def template_tokens(t):
    none = F.lit(None).cast("string")
    pattern = "{YYYY}{MM}{DD}-{HH}{mm}{ss}_{camera_make}_{camera_model}_{lens_model}_{sequence}_{original_name}_{iso}_{focal_length}{other}"
    return t.inventory.select("asset_id", N.template_name(
        pattern, c("path"), D.parse_taken(c("date_taken")), D.parse_taken(c("modified")), c("asset_id"),
        c("camera_make"), c("camera_model"), none, none, none).alias("new_name"))


@query("P7_sanitised_name", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '\{[^}]+\}', '', 'g'), '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '_. ') AS name FROM pages""")
def sanitised(t):
    return t.pages.select("page_id", N.sanitise(c("url")).alias("name"))


@query("P8_plain_characters", f"""
SELECT doc_id, left(translate(translate(text, ' /\\:*?"<>|', '_---------'), '{N.ACCENTED}', '{N.PLAIN}'), 200) AS name FROM documents""")
def plain_characters(t):
    return t.documents.select("doc_id", N.clean_characters(c("text")).alias("name"))


@query("P9_conflict_hash_suffix", """
SELECT asset_id, CASE WHEN is_dup THEN stem || '_' || substr(sha256, 1, 8) || regexp_extract(path, '\\.[^.]+$') ELSE filename END AS name
FROM (SELECT *, camera_make IS NULL AS is_dup FROM inventory)""")
def hash_suffix(t):
    return t.inventory.select("asset_id", N.with_hash(c("filename"), c("sha256"), c("camera_make").isNull()).alias("name"))


@query("P10_resolution_and_device", """
SELECT asset_id, CASE WHEN width = 1920 AND height = 1080 THEN '1080' WHEN width = 2560 AND height = 1440 THEN '1440' ELSE width || 'x' || height END AS resolution,
  CASE WHEN camera_make || ' ' || camera_model IN ('Sony ILCE-7M3', 'Canon EOS R5') THEN 'Camera' ELSE 'Unknown' END AS device FROM inventory""")
def resolution_device(t):
    return t.inventory.select("asset_id", N.resolution_short(c("width"), c("height")).alias("resolution"),
                              N.device_short(N.full_camera(c("camera_make"), c("camera_model"))).alias("device"))


@query("P11_document_type", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'invoice|receipt|payment|bill') THEN 'invoice'
  WHEN regexp_matches(lower(text), 'contract|agreement|terms') THEN 'contract' WHEN regexp_matches(lower(text), 'passport|license|id|card') THEN 'id_document'
  WHEN regexp_matches(lower(text), 'medical|prescription|lab|report') THEN 'medical' WHEN regexp_matches(lower(text), 'tax|return|1099|w2|t4') THEN 'tax'
  WHEN regexp_matches(lower(text), 'insurance|policy|claim') THEN 'insurance' WHEN regexp_matches(lower(text), 'legal|court|filing|petition') THEN 'legal'
  ELSE 'Document' END AS doc_type FROM documents""")
def document_type(t):
    return t.documents.select("doc_id", N.document_type(c("text")).alias("doc_type"))


@query("P12_screenshot_device", """
SELECT asset_id, CASE cam WHEN 0 THEN 'iPhone' WHEN 1 THEN 'iPad' WHEN 2 THEN 'Mac' WHEN 3 THEN 'Windows' ELSE 'Unknown' END AS device
FROM (SELECT asset_id, (asset_id // 20) % 5 AS cam FROM inventory)""")
def screenshot_device(t):
    cam = F.floor(c("asset_id") / 20) % 5
    name = F.concat(F.lit("Screenshot 1 on "), F.element_at(F.array(*map(F.lit, ("iPhone", "iPad", "Mac", "Windows", "other"))), (cam + 1).cast("int")))
    return t.inventory.select("asset_id", N.screenshot_device(name).alias("device"))


@query("P13_operation_id", "SELECT asset_id, 'OP_20240101_000000_' || printf('%04d', asset_id) AS operation_id FROM inventory")
def operation_id(t):
    return t.inventory.select("asset_id", N.operation_id("20240101_000000", c("asset_id")).alias("operation_id"))


@query("P14_truncated_text", """
SELECT page_id, CASE WHEN length(url) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS short FROM pages""")
def truncated(t):
    return t.pages.select("page_id", N.truncate(c("url"), 20).alias("short"))


@query("P15_focal_and_shutter", """
SELECT p_partkey, p_size || ' mm' AS focal, '1/' || (p_size * 10) AS shutter FROM part""")
def focal_shutter(t):
    raw = F.concat(c("p_size").cast("string"), F.when(c("p_partkey") % 2 == 0, " mm").otherwise(""))
    return t.part.select("p_partkey", N.focal_text(raw).alias("focal"), N.shutter_text(F.concat(F.lit("1/"), c("p_size") * 10)).alias("shutter"))


@query("P16_keep_priority", """
SELECT path, CASE WHEN source LIKE '%1' THEN 1 WHEN source LIKE '%2' THEN 2 WHEN source LIKE '%3' THEN 3 WHEN source LIKE '%4' THEN 4 ELSE 5 END AS priority FROM inventory""")
def keep_priority(t):
    s = F.right(c("source"), F.lit(1))
    where = F.when(s == "1", "/x/01_PHOTOS").when(s == "2", "/x/DCIM").when(s == "3", "/x/PRIVATE").when(s == "4", "/media/card/root").otherwise("/x")
    return t.inventory.select("path", P.keep_priority(F.concat(where, c("path")), "/media/card/").alias("priority"))


@query("P17_relative_path", """
SELECT path, CASE WHEN path LIKE '/src1/%' THEN substr(path, 7) ELSE filename END AS rel_path FROM inventory""")
def relative_path(t):
    return t.inventory.select("path", P.relative_to(c("path"), "/src1").alias("rel_path"))


@query("P18_rewritten_paths", """
SELECT i.asset_id, CASE WHEN l.doc_id IS NOT NULL THEN '/moved' || i.path ELSE i.path END AS path FROM inventory i LEFT JOIN labels l ON l.doc_id = i.asset_id""")
def rewritten_paths(t):
    mapping = t.labels.select(c("doc_id").alias("asset_id")).join(t.inventory.select("asset_id", "path"), "asset_id").select(
        c("path").alias("old_path"), F.concat(F.lit("/moved"), "path").alias("new_path"))
    return rewrite_paths(t.inventory.select("asset_id", "path"), mapping)


@query("P19_destination_path", "SELECT asset_id, '/dest/' || filename AS dest_path FROM inventory")
def destination_path(t):
    from assetlake.plans.transfer import destination_paths

    ops = t.inventory.select("asset_id", c("path").alias("original_path"), c("path").alias("new_path"))
    return destination_paths(ops, "/src", "/dest").select("asset_id", "dest_path")


@query("P20_hash_head", "SELECT asset_id, substr(sha256, 1, 32) AS head FROM inventory")
def hash_head(t):
    return t.inventory.select("asset_id", H.hash_head(c("sha256")).alias("head"))


# --- dates ---------------------------------------------------------------------

_FMT = "yyyy-MM-dd HH:mm:ss"


@query("T1_exif_or_iso_date", "SELECT asset_id, strftime(taken_ts, '%Y-%m-%d %H:%M:%S') AS taken FROM inventory")
def exif_or_iso(t):
    return t.inventory.select("asset_id", F.date_format(D.parse_taken(c("date_taken")), _FMT).alias("taken"))


@query("T2_two_format_date", "SELECT asset_id, strftime(modified_ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM inventory")
def two_formats(t):
    text = F.when(c("asset_id") % 2 == 0, F.replace(c("modified"), F.lit("T"), F.lit(" "))).otherwise(
        F.concat(F.replace(F.substring("modified", 1, 10), F.lit("-"), F.lit(":")), F.lit(" "), F.substring("modified", 12, 8)))
    return t.inventory.select("asset_id", F.date_format(D.parse_taken(text), _FMT).alias("parsed"))


@query("T3_exif_to_iso_text", "SELECT asset_id, strftime(taken_ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM inventory")
def exif_iso_text(t):
    return t.inventory.select("asset_id", D.exif_to_iso_text(c("date_taken")).alias("iso"))


@query("T4_first_date", """
SELECT asset_id, CASE WHEN date_taken <> '' THEN date_taken ELSE modified END AS first_text,
  strftime(coalesce(taken_ts, modified_ts), '%Y-%m-%d %H:%M:%S') AS first_parsed FROM inventory""")
def first_date(t):
    return t.inventory.select("asset_id", D.first_present(c("date_taken"), c("created"), c("modified")).alias("first_text"),
                              F.date_format(D.first_parsed(c("date_taken"), c("modified")), _FMT).alias("first_parsed"))


@query("T5_month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_key(t):
    return t.orders.select("o_orderkey", D.month_key(c("o_orderdate")).alias("month"))


@query("T6_rolling_cutoff", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '2000-08-01' AS recent FROM orders")
def rolling_cutoff(t):
    return t.orders.select("o_orderkey", (c("o_orderdate") >= D.months_before(F.lit("2001-08-01"), 12)).alias("recent"))


@query("T7_running_seconds", f"SELECT event_id, round(epoch(TIMESTAMP '{AS_OF}') - epoch(ts), 3) AS seconds FROM events")
def running_seconds(t):
    return t.heartbeats.select("event_id", F.round(D.seconds_between(c("ts"), F.lit(AS_OF).cast("timestamp")), 3).alias("seconds"))


@query("T8_duration_text", """
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS took
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)""")
def duration_text(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    end = F.timestamp_seconds(F.unix_seconds(start) + F.floor(c("o_totalprice") / 10))
    return t.orders.select("o_orderkey", D.duration_text(start, end).alias("took"))


@query("T9_backup_phase", """
SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') <= 365 THEN 1
  WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') <= 1095 THEN 2 ELSE 3 END AS phase FROM orders""")
def backup_phase(t):
    return t.orders.select("o_orderkey", D.backup_phase(c("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("phase"))


@query("T10_camera_time_to_utc", """
SELECT asset_id, strftime(modified_ts + to_hours(CASE WHEN modified_ts >= TIMESTAMP '2023-03-12 03:00:00' AND modified_ts < TIMESTAMP '2023-11-05 02:00:00' THEN 6 ELSE 7 END),
  '%Y-%m-%d %H:%M:%S') AS utc FROM inventory""")
def camera_to_utc(t):
    return t.inventory.select("asset_id", F.date_format(D.to_utc(D.parse_taken(c("modified"))), _FMT).alias("utc"))


# --- numbers, hashes, coordinates --------------------------------------------------

@query("M1_content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", *H.content_hashes(c("text").cast("binary")))


@query("M2_quick_hash", "SELECT doc_id, sha256(text) AS quick FROM documents")
def quick_hash(t):
    return t.documents.select("doc_id", H.quick_hash(c("text")).alias("quick"))


@query("M2_quick_hash_of_prefix", "SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 1, 128))) AS quick FROM documents")
def quick_hash_of_prefix(t):
    """The texts are shorter than the usual 1 MiB; nearly all are longer than 64 bytes."""
    return t.documents.select("doc_id", H.quick_hash(c("text"), 64).alias("quick"))


@query("M3_average_hash", "SELECT path, phash FROM picture_hashes")
def average_hash(t):
    return t.picture_hashes.select("path", "phash")


@query("M4_hamming_distance", """
SELECT a.size_bytes AS vec_id, CAST(bit_count(xor(a.word, b.word)) AS INTEGER) AS distance
FROM picture_hashes a JOIN picture_hashes b ON b.size_bytes = a.size_bytes + 1""")
def hamming(t):
    a = t.picture_hashes.select(c("size_bytes").alias("vec_id"), c("phash").alias("h1"))
    b = t.picture_hashes.select((c("size_bytes") - 1).alias("vec_id"), c("phash").alias("h2"))
    return a.join(b, "vec_id").select("vec_id", H.hamming(c("h1"), c("h2")).alias("distance"))


@query("M5_megabytes_and_gigabytes", """
SELECT o_orderkey, round(floor(o_totalprice) * 4096 / 1048576.0, 2) AS mb, round(floor(o_totalprice) * 4096 / 1073741824.0, 4) AS gb FROM orders""")
def mega_giga(t):
    size = F.floor("o_totalprice") * 4096
    return t.orders.select("o_orderkey", M.mib(size).alias("mb"), M.gib(size, 4).alias("gb"))


@query("M6_size_text", r"""
SELECT o_orderkey, CASE WHEN s = 0 THEN '0 B' ELSE regexp_replace(printf('%.2f', round(s / power(1024, k), 2)), '\.?0+$', '') || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[k + 1] END AS shown
FROM (SELECT o_orderkey, s, CASE WHEN s < 1024 THEN 0 WHEN s < 1048576 THEN 1 WHEN s < 1073741824 THEN 2 ELSE 3 END AS k
  FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 7) * (o_orderkey % 5) * 97 AS s FROM orders))""")
def size_text(t):
    size = F.floor("o_totalprice") * (c("o_orderkey") % 7) * (c("o_orderkey") % 5) * 97
    return t.orders.select("o_orderkey", M.size_text(size).alias("shown"))


@query("M7_guarded_percent", """
SELECT source, round(100.0 * coalesce(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END), 0) / greatest(count(*), 1), 4) AS pct FROM documents GROUP BY source""")
def guarded_percent(t):
    return t.documents.groupBy("source").agg(F.round(M.percent(F.count_if(c("n_chars") > 1000), F.count("*")), 4).alias("pct"))


@query("M8_decimal_degrees", """
SELECT c_custkey, round(CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END * ((c_custkey % 90) + (c_custkey % 60) / 60.0 + ((c_nationkey % 60) + 0.5) / 3600.0), 6) AS degrees FROM customer""")
def decimal_degrees(t):
    text = F.format_string("%d deg %d' %d.5\" X", c("c_custkey") % 90, c("c_custkey") % 60, c("c_nationkey") % 60)
    ref = F.when(c("c_nationkey") % 2 == 0, "S").otherwise("N")
    return t.customer.select("c_custkey", M.decimal_degrees(text, ref).alias("degrees"))


@query("M9_frame_rate", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE round(p_size * 1000 / (p_partkey % 4), 2) END AS fps FROM part""")
def frame_rate(t):
    return t.part.select("p_partkey", M.frame_rate(F.concat((c("p_size") * 1000).cast("string"), F.lit("/"), (c("p_partkey") % 4).cast("string"))).alias("fps"))


@query("M10_throughput", """
SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(count(*) / 12.5, 2) AS files_per_second, round(sum(n_chars) / 1048576.0 / 12.5, 2) AS mb_per_second FROM documents""")
def throughput(t):
    return A.audit_throughput(t.inventory, 12.5)


@query("M11_space_check", """
SELECT mount_path, free / 1073741824.0 >= need / 1073741824.0 * 1.5 AS passed, round(need / 1073741824.0 * 1.5, 2) AS required_gb, round(free / 1073741824.0, 2) AS available_gb,
  round(free / 1073741824.0 - need / 1073741824.0 * 1.5, 2) AS surplus_gb,
  CASE WHEN free / 1073741824.0 < need / 1073741824.0 * 1.5 THEN round(need / 1073741824.0 * 1.5 - free / 1073741824.0, 2) END AS deficit_gb
FROM (SELECT '/' || source AS mount_path, sum(size_bytes) * 1000000 AS need FROM inventory GROUP BY source)
JOIN (SELECT mount_path, capacity_bytes * 1000000 AS free FROM drives) USING (mount_path)""")
def space_check(t):
    files = t.inventory.select(F.concat(F.lit("/"), "source").alias("mount_path"), (c("size_bytes") * 1000000).alias("size_bytes"))
    return A.space_by_destination(files, t.drives.select("mount_path", (c("capacity_bytes") * 1000000).alias("free_bytes")))


# --- arrays and JSON ---------------------------------------------------------------

@query("N1_parsed_json_map", """
SELECT task_id, CASE WHEN metadata_json LIKE '{%' THEN json_extract_string(metadata_json, '$.file') END AS file,
  CAST(CASE WHEN metadata_json LIKE '{%' THEN 1 ELSE 0 END AS INTEGER) AS entries FROM task_log""")
def parsed_json(t):
    m = J.parse_map(c("metadata_json"))
    return t.task_log.select("task_id", m["file"].alias("file"), F.size(m).alias("entries"))


@query("N2_built_json", """
SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS json FROM documents""")
def built_json(t):
    return t.documents.select("doc_id", J.build_json(c("lang"), c("n_chars")).alias("json"))


@query("N3_exploded_operations", """
SELECT o_orderkey, CAST(u.i AS INTEGER) AS position, split_part(o_orderpriority, '-', u.i + 1) AS part FROM orders, (SELECT unnest([0, 1]) AS i) u""")
def exploded(t):
    doc = t.orders.select("o_orderkey", F.struct(F.split("o_orderpriority", "-").alias("operations")).alias("d"))
    return doc.select("o_orderkey", F.posexplode("d.operations").alias("position", "part"))


@query("N4_group_members", """
SELECT sha256, 0 AS part, 1 AS parts, string_agg(path, ',' ORDER BY path) AS members FROM inventory GROUP BY sha256 HAVING count(*) > 1""")
def group_members(t):
    from assetlake.operators.duplicates import exact_group_lists

    return exact_group_lists(t.inventory).withColumn("members", F.array_join("members", ","))


@query("N5_joined_text", """
SELECT sha256, 0 AS part, string_agg(path, ' | ' ORDER BY path) AS paths FROM inventory GROUP BY sha256""")
def joined_text(t):
    return member_lists(t.inventory, "sha256", "path").select("sha256", "part", F.array_join("members", " | ").alias("paths"))


@query("N6_first_of_array", """
SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS first_words FROM documents""")
def first_of_array(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("first_words"))


@query("N7_sidecar_struct", """
SELECT asset_id, '{"version":"1.0","created":"2024-01-15T00:00:00Z","original_filename":"' || filename || '","original_path":"' || path || '","new_filename":"' || filename ||
  '","unique_id":"sha256:' || sha256 || '","metadata":{' || CASE WHEN camera_make IS NULL THEN '' ELSE '"camera_make":"' || camera_make || '"' END ||
  '},"transfer_info":{"operation_id":"OP_' || asset_id || '"}}' AS sidecar FROM inventory""")
def sidecar_struct(t):
    doc = J.transfer_sidecar(c("path"), c("filename"), c("sha256"), F.struct("camera_make"), F.concat(F.lit("OP_"), c("asset_id").cast("string")),
                             F.lit(AS_OF).cast("timestamp"))
    return t.inventory.select("asset_id", F.to_json(doc).alias("sidecar"))


@query("N8_keyword_membership", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS tagged FROM orders")
def keyword_membership(t):
    words = F.to_json(F.array("o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", (J.has_keyword(words, "F") | J.has_keyword(words, "1-URGENT")).alias("tagged"))


@query("S10_exif_records", """
SELECT path, camera_make, camera_model, strftime(taken_ts, '%Y-%m-%dT%H:%M:%S') AS date_taken, (width // 10) || ' mm' AS focal_length, CAST(height AS INTEGER) AS iso FROM inventory""")
def exif_records(t):
    from assetlake.sources.readers import parse_exif

    lines = t.inventory.select(F.to_json(F.struct(
        c("path").alias("SourceFile"), c("camera_make").alias("Make"), c("camera_model").alias("CameraModel"), c("date_taken").alias("CreateDate"),
        F.concat(F.floor(c("width") / 10).cast("string"), F.lit(" mm")).alias("FocalLength"), c("height").alias("ISO"))).alias("value"))
    return parse_exif(lines).select("path", "camera_make", "camera_model", "date_taken", "focal_length", "iso")


@query("S11_probe_records", """
SELECT path, 12.5 :: DOUBLE AS duration, 'h264' AS codec, width, height, round(30000 / 1001, 2) AS fps, CAST(size_bytes AS BIGINT) AS bitrate FROM inventory""")
def probe_records(t):
    from assetlake.sources.readers import parse_probe

    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("0/0").alias("r_frame_rate"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), "width", "height", F.lit("30000/1001").alias("r_frame_rate"))
    lines = t.inventory.select(F.to_json(F.struct(
        "path", F.struct(F.lit("12.5").alias("duration"), c("size_bytes").cast("string").alias("bit_rate")).alias("format"), F.array(audio, video).alias("streams"))).alias("value"))
    return parse_probe(lines).select("path", "duration", "codec", "width", "height", "fps", "bitrate")
