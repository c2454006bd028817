"""Manifests, transfer outcomes, roll-back plans, sidecars, the ingestion verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import documents as J
from assetlake.functions import hashes as H
from assetlake.functions import names as N
from assetlake.functions import paths as P
from assetlake.operators.filters import newer_than
from assetlake.operators.joins import integrity
from assetlake.operators.skew import number_rows
from assetlake.operators.sorting import top


def operation_manifest(plan: DataFrame, stamp: str, created: str, limit: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Pending operations from a rename plan ``old_path, new_path``, in path order.

    The whole plan is numbered, however long; ``limit`` takes its first rows only, for a first batch.
    """
    rows = plan.select("old_path", "new_path")
    rows = number_rows(top(rows, limit, "old_path") if limit else rows, ["old_path"])
    if sizes is not None:
        rows = rows.join(sizes.select(F.col("path").alias("old_path"), F.col("size_bytes").alias("_size")), "old_path", "left")
    else:
        rows = rows.withColumn("_size", F.lit(0).cast("long"))
    op = N.operation_id(stamp, F.col("seq"))
    return rows.select(
        op.alias("operation_id"), F.col("old_path").alias("original_path"), "new_path",
        P.name(F.col("old_path")).alias("original_filename"), P.name(F.col("new_path")).alias("new_filename"),
        F.lit("").alias("hash_before"), F.lit("").alias("hash_after"), F.lit(created).alias("timestamp"),
        F.lit("pending").alias("status"), F.coalesce("_size", F.lit(0)).cast("long").alias("file_size"), F.lit("").alias("error"),
        F.lit(False).alias("rolled_back"), F.concat(F.lit("CP_"), op).alias("checkpoint_id"))


def checkpoint_records(manifest: DataFrame, task_id: str, created: str) -> DataFrame:
    """One checkpoint record per operation."""
    return manifest.select(
        "checkpoint_id", "operation_id", F.lit(created).alias("created"), F.lit(task_id).alias("task_id"), "original_path", "new_path",
        F.lit("pending").alias("status"), F.lit(True).alias("can_rollback"), F.lit(None).cast("string").alias("rollback_path"),
        F.struct("file_size", "original_filename", "new_filename").alias("metadata"))


def destination_paths(operations: DataFrame, source: str, dest: str) -> DataFrame:
    """Actual paths of a transfer: relative sources lie below the source root, and every
    target is the new name directly below the destination."""
    p, root = F.col("original_path"), source.rstrip("/")
    full = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(f"{root}/"), p))
    return operations.withColumns({
        "source_path": full, "dest_path": F.concat(F.lit(f"{dest.rstrip('/')}/"), P.name(F.col("new_path")))})


def rollback_plan(manifest: DataFrame, present: DataFrame, n: int = 50, verify_hash: bool = True) -> DataFrame:
    """What undoing the last ``n`` completed operations would do."""
    last = top(manifest.filter("status = 'completed'"), n, F.desc("timestamp"), "operation_id")
    now = present.select(F.col("path").alias("new_path"), F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    df = last.join(now, "new_path", "left")
    bad = (F.col("hash_after") != "") & ~F.col("_now").eqNullSafe(F.col("hash_after")) if verify_hash else F.lit(False)
    status = F.when(F.col("_there").isNull(), "skipped").when(bad, "failed").otherwise("dry_run")
    reason = (
        F.when(F.col("_there").isNull(), "New file does not exist")
        .when(bad, F.concat(F.lit("Hash mismatch: expected "), H.hash_head(F.col("hash_after"), 16), F.lit("..., got "),
                            F.coalesce(F.concat(H.hash_head(F.col("_now"), 16), F.lit("...")), F.lit("None")))))
    return df.select(
        "operation_id", status.alias("status"), reason.alias("reason"), F.when(status == "dry_run", F.col("original_path")).alias("would_restore"))


def rollback_candidates(manifest: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    return newer_than(manifest.filter("status = 'completed'"), as_of, hours)


def operation_integrity(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Integrity of single operations; here a missing first hash is an error of its own."""
    checked = integrity(manifest.withColumn("_status", F.col("status")).withColumn("status", F.lit("completed")), present)
    cur, exp = F.col("current_hash"), F.col("expected_hash")
    none_before = F.coalesce(F.col("hash_before"), F.lit("")) == ""
    message = (
        F.when(F.col("outcome") == "missing", "File does not exist")
        .when(none_before, "No hash_before recorded")
        .when(F.col("outcome") == "unreadable", "Cannot compute current hash")
        .when(cur == exp, F.concat(F.lit("Hash verified: "), H.hash_head(cur, 16), F.lit("...")))
        .otherwise(F.concat(F.lit("Hash mismatch: expected "), H.hash_head(exp, 16), F.lit("..., got "), H.hash_head(cur, 16), F.lit("..."))))
    valid = (F.col("outcome") == "verified") & ~none_before
    return checked.select("operation_id", "new_path", F.col("_status").alias("status"), valid.alias("is_valid"), message.alias("message"))


def sidecars(operations: DataFrame, files: DataFrame, created: Column) -> DataFrame:
    """``path, sidecar`` as JSON text for operations whose file is present."""
    f = files.select(F.col("path").alias("original_path"), "sha256", "camera_make", "camera_model", "date_taken")
    df = operations.join(f, "original_path")
    meta = F.struct("camera_make", "camera_model", D.exif_to_iso_text(F.col("date_taken")).alias("date_taken"))
    doc = J.transfer_sidecar(F.col("original_path"), F.col("new_filename"), F.col("sha256"), meta, F.col("operation_id"), created)
    return df.select(F.col("original_path").alias("path"), F.to_json(doc).alias("sidecar"))


def planned_sidecars(plan: DataFrame, files: DataFrame, created: Column) -> DataFrame:
    """Second sidecar form, numbered in path order."""
    f = files.select(F.col("path").alias("old_path"), "sha256", "size_bytes", "camera_make", "camera_model")
    df = number_rows(plan.join(f, "old_path"), ["old_path"])
    meta = F.struct("camera_make", "camera_model")
    doc = J.planned_sidecar(F.col("seq"), F.col("old_path"), P.name(F.col("new_path")), F.col("sha256"), F.col("size_bytes"), meta, created)
    return df.select(F.col("old_path").alias("path"), F.to_json(doc).alias("sidecar"))


def run_verdict(steps: DataFrame) -> DataFrame:
    """State of each run from its steps ``run, step, status``: a failed audit, confirmation or
    transfer aborts, any other failed step leaves errors."""
    failed = F.col("status") == "FAILED"
    fatal = failed & F.col("step").isin("audit", "confirmation", "transfer")
    return steps.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if(failed).alias("failed_steps"), F.count_if(fatal).alias("_fatal")
    ).select("run", "steps", "failed_steps",
             F.when(F.col("failed_steps") > 0, "COMPLETED_WITH_ERRORS").otherwise("SUCCESS").alias("status"),
             (F.col("_fatal") > 0).alias("aborted"))
