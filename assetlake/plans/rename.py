"""Rename plans. Tables come out; no file is touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import dates as D
from assetlake.functions import names as N
from assetlake.functions import paths as P
from assetlake.operators.skew import attach, number_rows
from assetlake.operators.windows import bursts, flag_conflicts, sequence


def _classified(files: DataFrame) -> DataFrame:
    path = F.col("path")
    taken = D.first_parsed(F.col("date_taken"), F.col("modified"))
    sfx = P.suffix_lower(path)
    return files.select(
        "path", taken.alias("_taken"), sfx.alias("_sfx"), N.rename_reason(sfx, taken).alias("skip_reason"),
        N.camera_short(N.full_camera(F.col("camera_make"), F.col("camera_model"))).alias("camera"),
        D.first_present(F.col("date_taken"), F.col("modified")).alias("_sort"),
        P.parent(path).alias("folder"),
    ).withColumn("date_key", F.date_format("_taken", "yyyy-MM-dd"))


def audit_plan(files: DataFrame, reset_on: Sequence[str] = ("date_key",)) -> DataFrame:
    """``old_path, new_path, reason, conflict_check``: dated, numbered names for photos.

    Numbers follow the order of the raw date text, then the path, and restart per date (or
    per ``camera``, ``folder``, or never). Only files that get a name are numbered.
    """
    photos = _classified(files).filter("skip_reason = 'ok'")
    numbered = sequence(photos, ["_sort", "path"], reset_on)
    named = numbered.withColumn(
        "new_path", P.join_path(F.col("folder"), N.dated_name(F.col("_taken"), F.col("camera"), F.col("seq"), F.col("_sfx"))))
    flagged = flag_conflicts(named, F.lower("new_path"), ["date_key", "seq", "path"])
    return flagged.select(
        F.col("path").alias("old_path"), "new_path", F.concat(F.lit("rename_"), F.substr(F.col("_sfx"), F.lit(2))).alias("reason"),
        F.when(F.col("conflict"), "CONFLICT").otherwise("ok").alias("conflict_check"))


def audit_plan_statistics(files: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: total, renamed, skipped by reason, conflicts, targets in conflict."""
    r = F.col("skip_reason")
    a = _classified(files).agg(
        F.count("*").alias("total"), F.count_if(r == "ok").alias("renamed"),
        F.count_if(r == "not_photo").alias("skipped_not_photo"), F.count_if(r == "no_date").alias("skipped_no_date"))
    hit = plan.filter("conflict_check = 'CONFLICT'").groupBy(F.lower("new_path").alias("t")).agg(F.count("*").alias("n"))
    b = hit.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("conflicts"), F.count("*").alias("conflict_targets"))
    return a.unionByName(b, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in (*a.columns, *b.columns)])


def template_plan(files: DataFrame, pattern: str | Column, existing: DataFrame | None = None) -> DataFrame:
    """Names from a token pattern; RAW and JPG of one folder and stem share name and number.

    ``files`` needs path, date_taken, modified and the camera columns. The leading file of a
    pair (least path) gives the metadata. Adds ``renamed`` and ``conflict``: a name used
    before in the plan, or the path of an existing file.
    """
    path, sfx = F.col("path"), P.suffix_lower(F.col("path"))
    # A pair shares folder and stem; any other file stands alone under its full path.
    base = F.when(sfx.isin(*C.RAW_SUFFIXES, ".jpg"), P.without_suffix(path)).otherwise(path)
    kept = files.filter(sfx.isin(*C.TEMPLATE_SUFFIXES)).withColumn("_base", base)
    facts = {k: _opt(files, k) for k in ("date_taken", "modified", "camera_make", "camera_model", "lens_model", "iso", "focal_length")}
    lead = F.min(F.struct(path.alias("path"), *[v.cast("string").alias(k) for k, v in facts.items()]))
    groups = kept.groupBy("_base").agg(lead.alias("_lead"), F.count("*").alias("_n"))
    heads = number_rows(groups.select("_base", "_n", "_lead.*"), ["path"])
    stems = heads.select(
        "_base", "seq", F.when(F.col("_n") > 1, F.col("_base")).alias("pair_base"),
        P.stem(N.template_name(
            pattern, path, D.parse_taken(F.col("date_taken")), D.parse_taken(F.col("modified")), F.col("seq"), F.col("camera_make"),
            F.col("camera_model"), F.col("lens_model"), F.col("iso"), F.col("focal_length"))).alias("_stem"))
    named = attach(kept.select("path", "_base"), stems, ["_base"]).select(
        path.alias("source"), F.concat("_stem", P.suffix(path)).alias("new_name"), "pair_base", "seq")
    plan = named.select(
        "source", P.join_path(P.parent(F.col("source")), F.col("new_name")).alias("destination"), "new_name", "pair_base", "seq",
        (F.col("new_name") != P.name(F.col("source"))).alias("renamed"))
    return flag_template_conflicts(plan, existing)


def _opt(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def flag_template_conflicts(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``conflict``: ``duplicate_name``, ``file_exists`` or null, for rows that are renamed."""
    todo = flag_conflicts(plan.filter("renamed"), F.col("new_name"), ["seq", "source"], "_again")
    if existing is None:
        todo = todo.withColumn("_taken", F.lit(False))
    else:
        e = existing.select(F.col("path").alias("destination"), F.lit(True).alias("_taken")).distinct()
        todo = todo.join(e, "destination", "left")
    taken = F.coalesce("_taken", F.lit(False)) & (F.col("destination") != F.col("source"))
    todo = todo.withColumn("conflict", F.when(F.col("_again"), "duplicate_name").when(taken, "file_exists")).drop("_again", "_taken")
    kept = plan.filter("not renamed").withColumn("conflict", F.lit(None).cast("string"))
    return todo.select(*kept.columns).unionByName(kept)


def burst_plan(files: DataFrame) -> DataFrame:
    """Names for burst shots: date, camera, burst number and number within the burst."""
    photos = _classified(files).filter("skip_reason = 'ok'")
    hit = bursts(photos, "_taken", "camera").filter("burst_index is not null")
    numbered = sequence(hit, ["_taken", "path"], ["camera", "burst_index"])
    return numbered.select(
        F.col("path").alias("old_path"), "burst_index", "burst_size",
        P.join_path(F.col("folder"), F.concat(
            F.date_format("_taken", "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), "camera", F.lit("_burst"), F.col("burst_index").cast("string"),
            F.lit("_"), F.format_string("%04d", F.col("seq")), F.col("_sfx"))).alias("new_path"))


def resolve_conflicts(plan: DataFrame, hashes: DataFrame) -> DataFrame:
    """Append the content hash to names in conflict. ``hashes`` has ``path, sha256``."""
    h = hashes.select(F.col("path").alias("old_path"), "sha256")
    name = N.with_hash(P.name(F.col("new_path")), F.col("sha256"), F.col("conflict_check") == "CONFLICT")
    return plan.join(h, "old_path", "left").withColumn(
        "new_path", F.coalesce(P.join_path(P.parent(F.col("new_path")), name), F.col("new_path"))).drop("sha256")


def document_plan(files: DataFrame) -> DataFrame:
    """Names for documents: date, type, stem and content hash."""
    path, taken = F.col("path"), D.first_parsed(F.col("date_taken"), F.col("modified"))
    name = F.concat(
        F.coalesce(F.date_format(taken, "yyyy-MM-dd"), F.lit("NODATE")), F.lit("_"), F.initcap(N.document_type(P.name(path), whole_numbers=True)), F.lit("_"),
        P.stem(path), F.lit("_"), F.substring("sha256", 1, 8), P.suffix(path))
    return files.select(path.alias("old_path"), P.join_path(P.parent(path), name).alias("new_path"))


def library_plan(files: DataFrame) -> DataFrame:
    """Destination folder of each file by class and date."""
    path, taken = F.col("path"), D.parse_taken(F.col("date_taken"))
    shot = F.lower(P.name(path)).contains("screenshot")
    return files.select("path", P.join_path(P.library_destination(F.col("file_type"), taken, shot), P.name(path)).alias("destination"))
