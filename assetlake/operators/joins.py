"""Joins between inventories, catalogs, backups, manifests and drives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import hashes as H
from assetlake.functions import paths as P
from assetlake.operators.skew import attach, best_per_key


# --- catalog -----------------------------------------------------------------

def catalog_images(images: DataFrame, files: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Images with the full path from root, folder, base name and extension."""
    place = folders.select(F.col("id").alias("id_folder"), "id_root", "pathFromRoot").join(
        roots.select(F.col("id").alias("id_root"), "absolutePath"), "id_root")
    file = files.select(F.col("id").alias("id_file"), "id_folder", "baseName", "extension").join(place, "id_folder")
    both = F.col("absolutePath").isNotNull() & F.col("pathFromRoot").isNotNull()
    full = F.concat(
        F.when(both, F.concat("absolutePath", "pathFromRoot")).otherwise(F.lit("")),
        F.coalesce("baseName", F.lit("")),
        F.when(F.col("extension") != "", F.concat(F.lit("."), "extension")).otherwise(F.lit("")),
    )
    return images.join(file, "id_file").withColumn("full_path", full)


def with_develop(images: DataFrame, develop: DataFrame) -> DataFrame:
    return images.join(develop.drop("processVersion") if "processVersion" in images.columns else develop, "id", "left")


def with_parent_name(tree: DataFrame, key: str = "id", parent: str = "parent", name: str = "name") -> DataFrame:
    up = tree.select(F.col(key).alias("_pid"), F.col(name).alias("parent_name"))
    return tree.join(up, F.col(parent) == F.col("_pid"), "left").drop("_pid")


def tagged_images(tags: DataFrame, links: DataFrame, tag_key: str = "id_keyword") -> DataFrame:
    """Keyword (or collection) to image rows."""
    return tags.join(links, F.col("id") == F.col(tag_key), "inner").drop(tag_key)


def catalog_presence(files: DataFrame, catalog_paths: DataFrame, path: str = "path", flag: str = "in_catalog") -> DataFrame:
    """Flag files whose path, or path without suffix, is a catalog path, with or without suffix."""
    cat = catalog_paths.select(F.col(catalog_paths.columns[0]).alias("_c"))
    keys = cat.select("_c").union(cat.select(P.without_suffix(F.col("_c")))).distinct().withColumn("_hit", F.lit(True))
    bare = keys.withColumnsRenamed({"_c": "_b", "_hit": "_hit_bare"})
    return (
        files.join(keys, F.col(path) == F.col("_c"), "left")
        .withColumn("_bare", P.without_suffix(F.col(path)))
        .join(bare, F.col("_bare") == F.col("_b"), "left")
        .withColumn(flag, F.coalesce("_hit", "_hit_bare", F.lit(False)))
        .drop("_c", "_hit", "_b", "_hit_bare", "_bare")
    )


def in_catalog(files: DataFrame, catalog_paths: DataFrame, path: str = "path") -> DataFrame:
    return files.join(catalog_paths.select(F.col(catalog_paths.columns[0]).alias(path)), path, "left_semi")


def missing_references(catalog: DataFrame, assets: DataFrame) -> DataFrame:
    """Missing catalog entries with the asset's present path, when it has one."""
    now = assets.select(F.col("id").alias("asset_id"), "file_path")
    return catalog.filter("is_missing").join(now, "asset_id", "left").select("catalog_file_path", "file_path")


# --- backups -----------------------------------------------------------------

def without_backup(assets: DataFrame, backups: DataFrame, per_asset: bool = False) -> DataFrame:
    """Assets with no backup record, or with a record that is not ``backed_up``.

    An asset with several such records comes once per record, as an outer join gives it;
    ``per_asset`` gives one row per asset.
    """
    b = backups.select(F.col("asset_id").alias("id"), "backup_status")
    if per_asset:
        b = b.groupBy("id").agg(F.min(F.col("backup_status") == "backed_up").alias("_ok"))
        return assets.join(b, "id", "left").filter("_ok is null or not _ok").drop("_ok")
    return assets.join(b, "id", "left").filter("backup_status is null or backup_status <> 'backed_up'").drop("backup_status")


def with_backup_at(assets: DataFrame, backups: DataFrame, location: str) -> DataFrame:
    """Assets with their backup status at one location."""
    b = backups.filter(F.col("backup_location") == location).select(F.col("asset_id").alias("id"), "backup_status")
    return assets.join(b, "id", "left")


def backup_listing(assets: DataFrame, backups: DataFrame, good: str = "verified") -> DataFrame:
    a = assets.select(F.col("id").alias("asset_id"), "file_path")
    return backups.filter(F.col("backup_status") != good).join(a, "asset_id")


def compare_backup(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """Full comparison by relative path: ``missing / extra / mismatch / verified``.

    Rows without a hash take no part; count them with ``aggregates.count_and_size``.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.filter(F.col("sha256") != "").select(
            "rel_path", F.col("sha256").alias(f"{tag}_hash"), F.col("size_bytes").alias(f"{tag}_size"))

    outcome = (
        F.when(F.col("backup_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "extra")
        .when(F.col("primary_hash") != F.col("backup_hash"), "mismatch").otherwise("verified")
    )
    return side(primary, "primary").join(side(backup, "backup"), "rel_path", "full_outer").withColumn("outcome", outcome)


def three_way_compare(stored: DataFrame, local: DataFrame, backup: DataFrame, cloud: DataFrame) -> DataFrame:
    """Compare the hash of each file at three places."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("path", F.col("sha256").alias(f"{tag}_hash"))

    out = stored.select("path")
    for df, tag in ((local, "local"), (backup, "backup"), (cloud, "cloud")):
        out = out.join(side(df, tag), "path", "left")
    return out.withColumn(
        "outcome",
        F.when(~F.col("local_hash").eqNullSafe(F.col("backup_hash")), "backup_corrupt")
        .when(~F.col("local_hash").eqNullSafe(F.col("cloud_hash")), "cloud_failed").otherwise("verified"),
    )


# --- drives ------------------------------------------------------------------

def with_drive(assets: DataFrame, drives: DataFrame, path: str = "file_path", key: str = "id", longest: bool = True) -> DataFrame:
    """Attach the drive whose mount path is a text prefix of the file path.

    The prefix test runs as an equi-join: a path is cut at each length that a mount path
    has, so no pair of file and drive is looked at that does not match.
    """
    d = drives.filter(F.col("mount_path") != "")
    lengths = d.select(F.collect_set(F.length("mount_path"))).scalar()
    cut = assets.select(key, path).withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.length(path)).select(
        key, F.substr(F.col(path), F.lit(1), F.col("_n")).alias("mount_path"))
    hit = attach(cut, d, ["mount_path"])
    if longest:
        hit = best_per_key(hit, [key], [F.length("mount_path"), "mount_path"], d.columns, latest=True)
    return assets.join(hit, key, "left")


def on_drive(assets: DataFrame, drives: DataFrame, serial: str, prefix: str | None = None, path: str = "file_path") -> DataFrame:
    """Assets below a prefix or on the drive with a serial number."""
    mount = drives.filter(F.col("serial_number") == serial).select(F.max("mount_path")).scalar()
    hit = F.startswith(F.col(path), mount)
    return assets.filter(F.col(path).startswith(prefix) | hit if prefix else hit)


# --- disk and manifest ---------------------------------------------------------

def rewrite_paths(df: DataFrame, mapping: DataFrame, path: str = "path") -> DataFrame:
    """Replace paths that a mapping ``old_path, new_path`` names exactly."""
    m = mapping.select(F.col("old_path").alias("_old"), F.col("new_path").alias("_new"))
    return df.join(m, F.col(path) == F.col("_old"), "left").withColumn(path, F.coalesce("_new", path)).drop("_old", "_new")


def moved_files(missing: DataFrame, orphan: DataFrame) -> DataFrame:
    """Files gone from their path whose content lies at a path the catalog does not know.

    One row per missing file: the least such path and how many there are, so that content
    with many copies does not multiply.
    """
    where = orphan.filter(F.col("sha256") != "").groupBy("sha256").agg(
        F.min("path").alias("found_path"), F.count("*").alias("places"))
    return attach(missing.filter(F.col("sha256") != "").select(F.col("path").alias("missing_path"), "sha256"), where, ["sha256"])


def reconcile(catalog: DataFrame, disk: DataFrame, suffixes: Sequence[str] = C.CATALOG_SUFFIXES) -> DataFrame:
    """``path, category``: A both, B in the catalog only, C media on disk only."""
    c = catalog.select("path").filter("path <> ''").distinct().withColumn("_c", F.lit(True))
    d = disk.select("path").distinct().withColumn("_d", F.lit(True))
    both = c.join(d, "path", "full_outer")
    media = P.suffix_lower(F.col("path")).isin(*suffixes)
    return both.select(
        "path", F.when(F.col("_d").isNull(), "B").when(F.col("_c").isNull(), "C").otherwise("A").alias("category")
    ).filter((F.col("category") != "C") | media)


def reconcile_hashes(catalog: DataFrame, disk: DataFrame, suffixes: Sequence[str] = C.CATALOG_SUFFIXES) -> DataFrame:
    """``reconcile`` with ``catalog_sha256`` and ``disk_sha256``, carried through the one join.
    Of several hashes recorded for a path the least counts."""
    c = catalog.filter("path <> ''").groupBy("path").agg(F.min("sha256").alias("catalog_sha256")).withColumn("_c", F.lit(True))
    d = disk.groupBy("path").agg(F.min("sha256").alias("disk_sha256")).withColumn("_d", F.lit(True))
    media = P.suffix_lower(F.col("path")).isin(*suffixes)
    category = F.when(F.col("_d").isNull(), "B").when(F.col("_c").isNull(), "C").otherwise("A")
    return c.join(d, "path", "full_outer").select("path", category.alias("category"), "catalog_sha256", "disk_sha256").filter(
        (F.col("category") != "C") | media)


def folder_drift(catalog_files: DataFrame, disk_files: DataFrame) -> DataFrame:
    """Folders whose file counts differ between catalog and disk."""
    a = catalog_files.groupBy("folder").agg(F.count("*").alias("catalog_count"))
    b = disk_files.groupBy("folder").agg(F.count("*").alias("disk_count"))
    kind = (
        F.when(F.col("disk_count").isNull(), "lr_only").when(F.col("catalog_count").isNull(), "disk_only")
        .when(F.col("catalog_count") != F.col("disk_count"), "mismatched")
    )
    return a.join(b, "folder", "full_outer").withColumn("drift", kind).filter("drift is not null")


def duplicate_paths(duplicates: DataFrame, assets: DataFrame, action: str = "pending") -> DataFrame:
    """Recorded duplicate pairs with the paths of both assets."""
    a1 = assets.select(F.col("id").alias("asset_id_1"), F.col("file_path").alias("file_path_1"))
    a2 = assets.select(F.col("id").alias("asset_id_2"), F.col("file_path").alias("file_path_2"))
    return duplicates.filter(F.col("action_taken") == action).join(a1, "asset_id_1").join(a2, "asset_id_2").select(
        "file_path_1", "file_path_2", "duplicate_type", "similarity_score")


def integrity(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Outcome of each operation against the hash now at its new path."""
    now = present.select(F.col("path").alias("new_path"), F.col("sha256").alias("current_hash"), F.lit(True).alias("_there"))
    after, before = F.when(F.col("hash_after") != "", F.col("hash_after")), F.when(F.col("hash_before") != "", F.col("hash_before"))
    cur = F.when(F.col("current_hash") != "", F.col("current_hash"))
    out = manifest.join(now, "new_path", "left").withColumn("expected_hash", F.coalesce(after, before))
    done = F.col("status").isin("completed", "rolled_back")
    outcome = (
        F.when(~done, "not_completed").when(F.col("_there").isNull(), "missing").when(cur.isNull(), "unreadable")
        .when(F.col("expected_hash").isNull(), "no_reference").when(cur == F.col("expected_hash"), "verified").otherwise("mismatch")
    )
    error = (
        F.when(F.col("outcome") == "not_completed", F.concat(F.lit("Operation not completed (status: "), F.col("status"), F.lit(")")))
        .when(F.col("outcome") == "missing", "File does not exist")
        .when(F.col("outcome") == "unreadable", "Failed to compute current hash")
        .when(F.col("outcome") == "no_reference", "No reference hash available")
        .when(F.col("outcome") == "mismatch", F.concat(
            F.lit("Hash mismatch: expected "), H.hash_head(F.col("expected_hash")), F.lit("..., got "), H.hash_head(cur), F.lit("...")))
        .otherwise("")
    )
    return out.withColumn("outcome", outcome).withColumn("error", error).drop("_there")


def pending_operations(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Operations not yet completed; failed ones are pending again."""
    return manifest.join(done.select("operation_id"), "operation_id", "left_anti")


def pending_after(manifest: DataFrame, last_index: int, position: str = "position") -> DataFrame:
    """Resume by position: everything after the last success."""
    return manifest.filter(F.col(position) > last_index)


def transfer_outcome(
    operations: DataFrame, source: DataFrame, before: DataFrame, after: DataFrame | None = None, attempts: int = 3,
) -> DataFrame:
    """What becomes of each copy, from the inventories around it.

    ``operations`` has ``operation_id, source_path, dest_path`` and optionally ``expected_hash``.
    ``before`` is the destination ahead of the copy and ``after`` the one behind it; without
    ``after``, copies still to do are ``NEW``.
    """
    ops = operations if "expected_hash" in operations.columns else operations.withColumn("expected_hash", F.lit(None).cast("string"))
    src = source.select(F.col("path").alias("source_path"), F.col("sha256").alias("hash_before"), "size_bytes", F.lit(True).alias("_src"))
    old = before.select(F.col("path").alias("dest_path"), F.col("sha256").alias("_old"), F.lit(True).alias("_dst"))
    df = ops.join(src, "source_path", "left").join(old, "dest_path", "left")
    if after is not None:
        df = df.join(after.select(F.col("path").alias("dest_path"), F.col("sha256").alias("hash_after")), "dest_path", "left")
    else:
        df = df.withColumn("hash_after", F.lit(None).cast("string"))
    expected = F.when(F.col("expected_hash") != "", F.col("expected_hash"))
    same = F.coalesce(F.col("_old") == F.coalesce(expected, F.col("hash_before")), F.lit(False))
    unread = F.col("hash_before").isNull() | (F.col("hash_before") == "")
    wrong = F.coalesce(F.col("hash_before") != expected, F.lit(False))
    def result(status: str, error: str = ""):
        return F.struct(F.lit(status).alias("status"), F.lit(error).alias("error"))

    chain = (
        F.when(F.col("_src").isNull(), result("SKIPPED", "Source file does not exist"))
        .when(F.col("_dst").isNotNull() & same, result("SKIPPED_EXISTING", "Destination exists with matching hash"))
        .when(unread, result("FAILED", "Failed to compute source hash"))
        .when(wrong, result("FAILED", "Source hash mismatch"))
    )
    if after is None:
        chain = chain.otherwise(result("NEW"))
    else:
        chain = (
            chain.when(F.col("hash_after").isNull(), result("FAILED", f"Copy failed after {attempts} attempts"))
            .when(F.col("hash_after") == F.col("hash_before"), result("VERIFIED"))
            .otherwise(result("FAILED", f"Hash mismatch after {attempts} attempts"))
        )
    final = (
        F.when(F.col("status").isin("VERIFIED", "SKIPPED", "SKIPPED_EXISTING"), "completed")
        .when(F.col("status") == "NEW", "pending").otherwise("failed")
    )
    return (
        df.withColumn("_r", chain)
        .select("operation_id", "source_path", "dest_path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
                "hash_before", "hash_after", "_r.status", "_r.error")
        .withColumn("final_status", final)
        .withColumn("success", F.col("status").isin("VERIFIED", "SKIPPED_EXISTING"))
    )


# --- RAW and JPG pairs -----------------------------------------------------------

def raw_jpg_pairs(files: DataFrame, jpg: Sequence[str] = (".jpg",), path: str = "path") -> DataFrame:
    """Files of one folder and stem that exist as RAW and JPG, with ``pair_base``."""
    p = F.col(path)
    kept = files.filter(P.suffix_lower(p).isin(*C.RAW_SUFFIXES, *jpg)).withColumn("pair_base", P.without_suffix(p))
    groups = kept.groupBy("pair_base").agg(F.count("*").alias("pair_files")).filter("pair_files > 1")
    return attach(kept, groups, ["pair_base"])


def pair_by_time(
    files: DataFrame, taken: str, by: str = "folder", seconds: int = C.PAIR_SECONDS, jpg: Sequence[str] = (".jpg", ".jpeg"),
) -> DataFrame:
    """RAW and JPG of one folder taken within some seconds of each other, nearest first.

    Each side picks its nearest partner (then the smaller path) and a pair counts when the
    picks agree. Both sides are first reduced to one file per second, and each second looks
    at the few seconds around it, so the join never multiplies files.
    """
    suffix = P.suffix_lower(F.col("path"))
    timed = files.withColumn("_s", F.unix_seconds(F.col(taken).cast("timestamp"))).filter("_s is not null")
    raw = timed.filter(suffix.isin(*C.RAW_SUFFIXES)).groupBy(by, "_s").agg(F.min("path").alias("raw_path"))
    pic = timed.filter(suffix.isin(*jpg)).groupBy(by, "_s").agg(F.min("path").alias("jpg_path"))
    near = raw.withColumn("_t", F.explode(F.sequence(F.col("_s") - seconds, F.col("_s") + seconds)))
    # At most 2 * seconds + 1 candidates on each side of a pair.
    cand = near.join(pic.withColumnRenamed("_s", "_t"), [by, "_t"]).select(
        by, "raw_path", "jpg_path", F.abs(F.col("_t") - F.col("_s")).alias("gap_seconds"))
    raw_pick = best_per_key(cand, ["raw_path"], ["gap_seconds", "jpg_path"], ["jpg_path", by, "gap_seconds"])
    jpg_pick = best_per_key(cand, ["jpg_path"], ["gap_seconds", "raw_path"], ["raw_path"])
    return raw_pick.join(jpg_pick, ["raw_path", "jpg_path"]).select(by, "raw_path", "jpg_path", "gap_seconds")
