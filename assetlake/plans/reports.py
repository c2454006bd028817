"""Report datasets: one DataFrame per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import measures as M
from assetlake.functions import names as N
from assetlake.operators import aggregates as A
from assetlake.operators import duplicates as U
from assetlake.operators import filters as X
from assetlake.operators import sorting as L
from assetlake.operators import windows as Q


def _badge():
    return F.when(F.col("file_type") == "IMAGE", "image").when(F.col("file_type") == "VIDEO", "video").otherwise("other")


def audit_totals(files: DataFrame) -> DataFrame:
    """The head line of the audit report, in one row."""
    dup = U.duplicate_stats(files).select("duplicate_groups", M.gib(F.col("recoverable_bytes")).alias("duplicate_space_gb"))
    base = files.agg(
        F.count("*").alias("total_files"), M.gib(F.sum("size_bytes")).alias("total_size_gb"),
        F.count_if(F.col("file_type") == "IMAGE").alias("image_count"), F.count_if(F.col("file_type") == "VIDEO").alias("video_count"))
    bare = X.missing_metadata(files).agg(F.count("*").alias("no_metadata_count"))
    parts = base.unionByName(dup, allowMissingColumns=True).unionByName(bare, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def audit_report(files: DataFrame) -> dict[str, DataFrame]:
    """All sections of the audit report."""
    shown = files.select(
        "filename", "path", F.format_string("%.3f", F.col("size_bytes") / float(1024**3)).alias("size_gb"), "file_type",
        _badge().alias("badge"), "size_bytes")
    return {
        "totals": audit_totals(files),
        "file_types": A.count_by_type(files),
        "timeline": A.timeline(files),
        "largest_files": L.largest_files(shown),
        "no_metadata_files": L.top(X.missing_metadata(files).select("filename", "path", "file_type", "modified"), 50, "path"),
        "duplicate_groups": top_groups(files),
        "all_files": manifest_rows(files),
    }


def top_groups(files: DataFrame, n: int = 20) -> DataFrame:
    """The duplicate groups with the most copies."""
    g = U.exact_groups(files)
    return L.top(g.select("sha256", "copies", "size_bytes", "recoverable_bytes"), n, F.desc("copies"), "sha256")


def manifest_rows(files: DataFrame) -> DataFrame:
    return files.select(
        "filename", "path", M.mib(F.col("size_bytes")).alias("size_mb"), "file_type", _badge().alias("badge"), "camera_model", "date_taken",
        N.truncate(F.coalesce("sha256", F.lit("")), 16).alias("sha256"))


def monthly_report(files: DataFrame, runs: DataFrame, activity: DataFrame, month: str) -> dict[str, DataFrame]:
    """All sections of the monthly summary.

    ``files`` has ``ingested_date, file_type, size_bytes``; ``runs`` has
    ``start_time, source, files, bytes, status``; ``activity`` as for ``monthly_activity``.
    """
    monthly = A.monthly_ingestion(files, "ingested_date", "size_bytes")
    new = files.filter(D.month_key(F.col("ingested_date")) == month)
    grown = Q.growth(Q.growth(monthly, "files_ingested", name="total_files"), "total_bytes", name="total_storage")
    return {
        "growth": grown,
        "change": Q.month_change(Q.month_change(monthly, "files_ingested").withColumnsRenamed(
            {"change": "files_change", "change_pct": "files_change_pct"}), "total_bytes").withColumnsRenamed(
            {"change": "bytes_change", "change_pct": "bytes_change_pct"}),
        "new_assets": A.storage_by_type(new),
        "top_ingests": L.top(runs.filter(D.month_key(F.col("start_time")) == month), 10, F.desc("files"), "start_time", "source"),
        "storage_by_type": A.storage_by_type(files),
        "activity": A.monthly_activity(activity).filter(F.col("month") == month),
    }
