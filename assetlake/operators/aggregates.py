"""Counts, totals, rates and statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import dates as D
from assetlake.functions import measures as M
from assetlake.operators.joins import without_backup


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def count_and_size(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    return df.agg(F.count("*").alias("files"), _zero(F.sum(size)).alias("bytes"))


def count_by(df: DataFrame, column: str, missing: str | int | None = None, name: str = "files") -> DataFrame:
    key = F.coalesce(F.col(column), F.lit(missing)) if missing is not None else F.col(column)
    return df.groupBy(key.alias(column)).agg(F.count("*").alias(name))


def count_by_type(df: DataFrame) -> DataFrame:
    return count_by(df, "file_type", "OTHER")


def timeline(df: DataFrame, strict: bool = False) -> DataFrame:
    """Files per month of the first present date; unreadable dates are left out."""
    text = D.first_present(F.col("date_taken"), F.col("created"), F.col("modified"))
    return (
        df.select(D.report_month(text, strict).alias("month")).filter("month is not null")
        .groupBy("month").agg(F.count("*").alias("files"))
    )


def monthly_ingestion(df: DataFrame, column: str = "ingested_date", size: str = "file_size_bytes") -> DataFrame:
    return df.groupBy(D.month_key(F.col(column)).alias("month")).agg(
        F.count("*").alias("files_ingested"), F.sum(size).alias("total_bytes"))


def count_by_rating(images: DataFrame) -> DataFrame:
    return images.groupBy(F.coalesce("rating", F.lit(0)).alias("rating")).agg(F.count("*").alias("images"))


def count_by_flag(images: DataFrame, flag: str = "pickFlags") -> DataFrame:
    """Always three rows: picked, rejected, unflagged."""
    f = F.col(flag)
    one = images.agg(
        F.count_if(f == 1).alias("p"), F.count_if(f == -1).alias("r"),
        F.count_if(f.isNull() | ~f.isin(1, -1)).alias("u"))
    return one.select(F.expr("stack(3, 'picked', p, 'rejected', r, 'unflagged', u) as (flag, images)"))


def images_per_tag(tags: DataFrame, links: DataFrame, tag_key: str = "id_keyword") -> DataFrame:
    """Images per keyword or collection, zeros kept; links are counted before the join."""
    n = links.groupBy(F.col(tag_key).alias("id")).agg(F.count("id_image").alias("image_count"))
    return tags.join(n, "id", "left").withColumn("image_count", _zero(F.col("image_count")))


def files_per_folder(folders: DataFrame, roots: DataFrame, files: DataFrame, keep_empty: bool = True) -> DataFrame:
    n = files.groupBy(F.col("id_folder").alias("id")).agg(F.count("id").alias("file_count"))
    r = roots.select(F.col("id").alias("id_root"), "absolutePath")
    return (
        folders.join(r, "id_root").join(n, "id", "left" if keep_empty else "inner")
        .select("id", F.concat(F.coalesce("absolutePath", F.lit("")), F.coalesce("pathFromRoot", F.lit(""))).alias("full_path"),
                _zero(F.col("file_count")).alias("file_count"))
    )


def catalog_statistics(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the row count of each named table."""
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in parts])


def backup_health(backups: DataFrame) -> DataFrame:
    s = F.col("backup_status")
    ok = F.count_if(s == "backed_up")
    return backups.groupBy("backup_location").agg(
        F.count("*").alias("total_assets"), ok.alias("backed_up_count"), F.count_if(s == "failed").alias("failed_count"),
        F.count_if(s == "pending").alias("pending_count"), F.round(100.0 * ok / F.count("*"), 2).alias("success_rate_pct"),
        F.max("last_backup_at").alias("last_successful_backup"))


def library_summary(assets: DataFrame, backups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Nine named metrics as doubles; seven come from one pass over the assets."""
    here, kind = ~F.col("is_missing"), F.col("file_type")
    size = F.sum(F.when(here, F.col("file_size_bytes")))
    one = assets.agg(
        F.count_if(here).alias("a"), F.round(_zero(size) / 1073741824.0, 2).alias("b"),
        F.count_if(here & (kind == "RAW")).alias("c"), F.count_if(here & (kind == "JPG")).alias("d"),
        F.count_if(here & (kind == "VIDEO")).alias("e"), F.count_if(here & F.col("is_duplicate")).alias("f"),
        F.count_if(~here).alias("g"))
    names = ("Total Assets", "Total Size (GB)", "RAW Files", "JPEG Files", "Video Files", "Duplicates", "Missing Files")
    pairs = ", ".join(f"'{n}', cast({c} as double)" for n, c in zip(names, "abcdefg"))
    present = assets.filter(here).select("id", "file_type")

    def unmatched(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        left = df.join(other.select(F.col("asset_id").alias("id")), "id", "left_anti")
        return left.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    return (
        one.select(F.expr(f"stack(7, {pairs}) as (metric, value)"))
        .unionByName(unmatched(present, backups, "Not Backed Up"))
        .unionByName(unmatched(present.filter(kind.isin("RAW", "JPG")), catalog, "Not in Lightroom"))
    )


def status_pivot(df: DataFrame, states: list[str], by: list[str] = (), column: str = "status") -> DataFrame:
    """Counts per status as columns, zero where there are none."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == s).alias(s.lower()) for s in states])


def drive_capacity(files: DataFrame, drives: DataFrame, drive_path: str = "mount_path") -> DataFrame:
    used = files.groupBy(drive_path).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("used_bytes"))
    return drives.join(used, drive_path, "left").select(
        drive_path, "capacity_bytes", _zero(F.col("files")).alias("files"), _zero(F.col("used_bytes")).alias("used_bytes"),
        F.round(M.percent(_zero(F.col("used_bytes")), F.col("capacity_bytes")), 2).alias("used_pct"))


def space_by_destination(files: DataFrame, drives: DataFrame, key: str = "mount_path", margin: float = C.SPACE_MARGIN) -> DataFrame:
    """Space check of each destination: planned bytes with a margin against free bytes."""
    need = files.groupBy(key).agg(F.sum("size_bytes").alias("required_bytes"))
    return need.join(drives.select(key, "free_bytes"), key, "left").withColumn(
        "_s", M.space_check(F.col("required_bytes"), F.coalesce("free_bytes", F.lit(0)), margin)
    ).select(key, "_s.*")


def integrity_tally(outcomes: DataFrame) -> DataFrame:
    """One row: total, verified, mismatch, missing, error. Anything else is an error."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("total"), F.count_if(o == "verified").alias("verified"), F.count_if(o == "mismatch").alias("mismatch"),
        F.count_if(o == "missing").alias("missing"), F.count_if(~o.isin("verified", "mismatch", "missing")).alias("error"))


def transfer_tally(log: DataFrame, by: list[str] = ()) -> DataFrame:
    s = F.col("status")
    return log.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(s == "VERIFIED").alias("verified"),
        F.count_if(s.isin("SKIPPED", "SKIPPED_EXISTING")).alias("skipped"), F.count_if(s == "FAILED").alias("failed"),
        _zero(F.sum(F.when(s == "VERIFIED", F.col("size_bytes")))).alias("total_bytes"))


def session_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("session", "status").agg(F.count("*").alias("files"))


def backup_verdict(compared: DataFrame, primary: DataFrame) -> DataFrame:
    """PASS or FAIL with the counts; the missing size as an estimate and exactly."""
    o = F.col("outcome")
    c = compared.agg(
        *[F.count_if(o == x).alias(x) for x in ("missing", "extra", "mismatch", "verified")],
        _zero(F.sum(F.when(o == "missing", F.col("primary_size")))).alias("missing_bytes"))
    p = count_and_size(primary).withColumnsRenamed({"files": "primary_files", "bytes": "primary_bytes"})
    both = c.unionByName(p, allowMissingColumns=True).agg(*[F.max(x).alias(x) for x in (*c.columns, *p.columns)])
    bad = F.col("missing") + F.col("extra") + F.col("mismatch")
    mean = F.when(F.col("primary_files") > 0, F.col("primary_bytes") / F.col("primary_files")).otherwise(0.0)
    return both.withColumn("status", F.when(bad == 0, "PASS").otherwise("FAIL")).withColumn(
        "missing_bytes_estimate", F.round(mean * F.col("missing"), 2))


def reconciliation_counts(categories: DataFrame) -> DataFrame:
    """Counts over ``path, category`` rows; the match share is of the catalog's paths."""
    c = F.col("category")
    return (
        categories.agg(F.count_if(c.isin("A", "B")).alias("catalog_paths"), F.count_if(c == "B").alias("missing_count"),
                       F.count_if(c == "C").alias("orphan_count"))
        .withColumn("match_percentage", F.round(M.percent(F.col("catalog_paths") - F.col("missing_count"), F.col("catalog_paths")), 4))
    )


def category_shares(categories: DataFrame) -> DataFrame:
    """Count and whole-number share per category. The window runs over one row per category."""
    n = categories.groupBy("category").agg(F.count("*").alias("files"))
    total = F.sum("files").over(W.partitionBy(F.lit(1)))
    return n.withColumn("share_pct", F.round(100.0 * F.col("files") / total).cast("long"))


def temperature_statistics(readings: DataFrame, events: DataFrame | None = None) -> DataFrame:
    t = F.col("temperature")
    out = readings.groupBy("drive").agg(F.min(t).alias("min_temperature"), F.max(t).alias("max_temperature"), F.round(F.avg(t), 2).alias("avg_temperature"))
    if events is None:
        return out
    n = events.groupBy("drive").agg(F.count_if(F.col("event") == "THERMAL_PAUSE").alias("pauses"), F.count_if(F.col("event") == "THERMAL_RESUME").alias("resumes"))
    return out.join(n, "drive", "left").withColumns({c: _zero(F.col(c)) for c in ("pauses", "resumes")})


def hash_statistics(results: DataFrame) -> DataFrame:
    """Batch statistics of hashing results ``size_bytes, processing_time_ms, error``."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    size, ms = _zero(F.sum(F.when(ok, F.col("size_bytes")))), F.coalesce(F.sum(F.when(ok, F.col("processing_time_ms"))), F.lit(0.0))
    return results.agg(
        F.count("*").alias("total_files"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"),
        size.alias("total_size_bytes"), M.gib(size, 3).alias("total_size_gb"), F.round(ms, 2).alias("total_processing_time_ms"),
        M.ratio(ms, F.count_if(ok)).alias("avg_processing_time_ms"), M.ratio(size / (1024.0 * 1024.0), ms / 1000.0).alias("throughput_mbps"))


def audit_throughput(files: DataFrame, seconds: float) -> DataFrame:
    return count_and_size(files).select(
        "files", "bytes", M.ratio(F.col("files"), F.lit(float(seconds))).alias("files_per_second"),
        M.ratio(F.col("bytes") / (1024.0 * 1024.0), F.lit(float(seconds))).alias("mb_per_second"))


def encoder_usage(probes: DataFrame) -> DataFrame:
    timed = probes.filter(F.col("thumbnail_time_ms") > 0)
    return timed.groupBy(F.coalesce("thumbnail_encoder", F.lit("unknown")).alias("encoder")).agg(
        F.count("*").alias("thumbnails"), F.round(F.avg("thumbnail_time_ms"), 2).alias("avg_time_ms"))


def task_health(tasks: DataFrame, as_of: Column) -> DataFrame:
    """One row: healthy, warning and failed counts and the overall state."""
    s, age = F.lower("status"), D.seconds_between(F.col("last_heartbeat"), as_of)
    return tasks.agg(
        F.count_if((s == "running") & (F.col("progress_pct") >= 0)).alias("healthy"),
        F.count_if((age >= 30) & (age < 60)).alias("warning"), F.count_if(s.isin("failed", "cancelled")).alias("failed"),
    ).withColumn("overall", F.when(F.col("failed") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("healthy"))


def distinct_paths(df: DataFrame, approximate: bool = False, path: str = "path") -> DataFrame:
    return df.agg((F.approx_count_distinct(path) if approximate else F.count_distinct(path)).alias("paths"))


def sidecar_counts(sidecars: DataFrame, target: int) -> DataFrame:
    """Sidecars per status with the share of the target; manifests are not sidecars."""
    kept = sidecars.filter(~F.col("filename").startswith("sidecar_manifest")) if "filename" in sidecars.columns else sidecars
    return kept.groupBy("status").agg(F.count("*").alias("sidecars")).withColumn(
        "target_pct", F.round(100.0 * F.col("sidecars") / F.lit(max(target, 1)), 2))


def storage_by_type(files: DataFrame) -> DataFrame:
    """Count, size and share per type. The window runs over one row per type."""
    n = files.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    total = F.sum("bytes").over(W.partitionBy(F.lit(1)))
    return n.withColumn("share_pct", F.round(100.0 * F.col("bytes") / F.greatest(total, F.lit(1)), 2))


def monthly_activity(events: DataFrame) -> DataFrame:
    """Activity per month from rows ``ts, kind, files, bytes, failed``."""
    k = F.col("kind")
    return events.groupBy(D.month_key(F.col("ts")).alias("month")).agg(
        F.count_if(k == "ingest").alias("drives_ingested"), _zero(F.sum(F.when(k == "ingest", F.col("files")))).alias("files_transferred"),
        _zero(F.sum(F.when(k == "dedupe", F.col("files")))).alias("duplicates_removed"),
        _zero(F.sum(F.when(k == "dedupe", F.col("bytes")))).alias("space_recovered"),
        F.count_if(k == "catalog").alias("catalog_updates"), F.count_if(k == "backup").alias("backup_syncs"),
        F.count_if((k == "backup") & F.col("failed")).alias("backup_failures"), F.count_if(k == "report").alias("reports_generated"))


def date_range(files: DataFrame, taken: Column) -> DataFrame:
    return files.agg(F.min(taken).alias("first_date"), F.max(taken).alias("last_date"), F.count(taken).alias("dated_files"))


def extension_shares(files: DataFrame) -> DataFrame:
    n = files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    total = F.sum("files").over(W.partitionBy(F.lit(1)))
    return n.withColumn("share_pct", F.round(100.0 * F.col("files") / total, 2))


def counts_by_folder(categories: DataFrame, folder: Column) -> DataFrame:
    c = F.col("category")
    return categories.groupBy(folder.alias("folder")).agg(
        F.count_if(c == "B").alias("missing"), F.count_if(c == "C").alias("orphans")).filter("missing > 0 or orphans > 0")


def audit_sample(files: DataFrame, share: float = C.AUDIT_SAMPLE_SHARE, at_least: int = C.AUDIT_SAMPLE_MIN, seed: str = "",
                 path: str = "path") -> DataFrame:
    """A repeatable sample of ``max(ceil(share * rows), at_least)`` files, least MD5 first.

    A histogram of the first four hex digits (65,536 counts) finds the digit where the quota
    is met; only the rows of that one digit group are ranked.
    """
    marked = files.withColumn("_m", F.md5(F.concat(F.lit(seed), F.col(path)))).withColumn("_b", F.substring("_m", 1, 4))
    hist = marked.groupBy("_b").agg(F.count("*").alias("_n"))
    all_rows, upto = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    quota = F.greatest(F.ceil(F.sum("_n").over(all_rows) * share), F.lit(at_least))
    room = hist.select("_b", "_n", (quota - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_room")).filter("_room > 0")
    # At most 65,536 rows.
    kept = marked.join(F.broadcast(room), "_b")
    whole = kept.filter("_n <= _room")
    edge = kept.filter("_n > _room").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_m", path))).filter("_r <= _room")
    return whole.select(*files.columns).unionByName(edge.select(*files.columns))


def dashboard(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: files, GB, verified, tasks complete and failed."""
    f = files.agg(F.count("*").alias("files"), M.gib(_zero(F.sum("size_bytes")), 2).alias("size_gb"), F.count_if("verified").alias("verified"))
    t = tasks.agg(F.count_if(F.col("status") == "COMPLETED").alias("tasks_complete"), F.count_if(F.col("status") == "FAILED").alias("tasks_failed"))
    return f.unionByName(t, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*f.columns, *t.columns)])


def files_per_drive(files: DataFrame, drive: str) -> DataFrame:
    return files.groupBy(drive).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def not_backed_up(assets: DataFrame, backups: DataFrame) -> DataFrame:
    return without_backup(assets, backups, per_asset=True).agg(F.count("*").alias("assets"))
