"""Catalog against disk: categories, priorities, and where assets lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.operators import joins as J
from assetlake.operators.duplicates import exact_members
from assetlake.operators.filters import not_like
from assetlake.operators.skew import attach
from assetlake.operators.sorting import rank_order


def reconciliation_matrix(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """``path, category, priority, found_path``.

    A in both; B missing from disk, with a place where the same content lies; C on disk only;
    D every member of a duplicate group (in addition to its A or C row). ``catalog`` and
    ``disk`` have ``path, sha256``; ``disk`` also ``size_bytes``.
    """
    cats = J.reconcile_hashes(catalog, disk)
    missing = cats.filter("category = 'B'").select("path", "category", F.nullif("catalog_sha256", F.lit("")).alias("sha256"))
    orphan = cats.filter("category = 'C' and disk_sha256 <> ''")
    where = orphan.groupBy(F.col("disk_sha256").alias("sha256")).agg(F.min("path").alias("found_path"))
    placed = cats.filter("category <> 'B'").select("path", "category").unionByName(
        attach(missing, where, ["sha256"], "left").drop("sha256"), allowMissingColumns=True)
    dup = exact_members(disk).select("path", F.lit("D").alias("category"))
    rank = F.when(F.col("category") == "B", "CRITICAL").when(F.col("category") == "C", "HIGH").when(F.col("category") == "D", "MEDIUM").otherwise("NONE")
    return placed.unionByName(dup, allowMissingColumns=True).withColumn("priority", rank).select(
        "path", "category", "priority", "found_path")


def backup_priorities(assets: DataFrame, backups: DataFrame, per_asset: bool = False) -> DataFrame:
    """Assets not safely backed up, the most urgent first."""
    level = F.when(F.col("file_type") == "RAW", "CRITICAL").when(F.col("lightroom_rating") >= 4, "HIGH").otherwise("MEDIUM")
    out = J.without_backup(assets, backups, per_asset).withColumn("priority", level)
    return out.orderBy(rank_order(F.col("priority"), "CRITICAL", "HIGH", "MEDIUM"), F.desc("date_taken"), "id")


def not_in_catalog(assets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Photos that no catalog holds, without screenshots and edited exports."""
    photos = not_like(assets.filter(F.col("file_type").isin("RAW", "JPG")), "file_path", ["%SCREENSHOTS%", "%EDITED%"])
    return photos.join(catalog.select(F.col("asset_id").alias("id")), "id", "left_anti")


def phased_upload(assets: DataFrame, backups: DataFrame, as_of: str, location: str = "r2", months: int = 12) -> DataFrame:
    """Assets of the last months not yet at a remote location."""
    cut = D.months_before(F.lit(as_of), months)
    recent = assets.filter(F.col("date_taken") >= cut)
    return J.with_backup_at(recent, backups, location).filter("backup_status is null or backup_status <> 'backed_up'").select(
        "id", "file_path", "file_size_bytes", "date_taken")


def copies_of(assets: DataFrame, drives: DataFrame, sha256: str) -> DataFrame:
    """All copies of one content with their drive; present ones first, then the oldest record."""
    hit = assets.filter(F.col("sha256_hash") == sha256)
    order = ["created_at"] if "created_at" in assets.columns else ["ingested_date"]
    return J.with_drive(hit, drives).orderBy("is_missing", *order, "id")


def assets_on_drive(assets: DataFrame, backups: DataFrame, drives: DataFrame, serial: str, prefix: str | None = None,
                    location: str = "local") -> DataFrame:
    """Assets of a drive (or below a prefix) with their backup status at one location."""
    return J.with_backup_at(J.on_drive(assets, drives, serial, prefix), backups, location).orderBy(F.desc("date_taken"), "id")
