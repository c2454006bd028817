"""Data-quality rules: allowed values, uniqueness, references, earlier ingestion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import dates as D
from assetlake.operators.skew import attach


def value_violations(
    df: DataFrame, key: str, allowed: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """``key, column, value`` of every value outside its list or range. A null value passes."""
    tests = []
    for c, values in (allowed or {}).items():
        tests.append((c, ~F.col(c).isin(*values)))
    for c, (low, high) in (ranges or {}).items():
        tests.append((c, ~F.col(c).between(low, high)))
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, bad in tests
    ]))
    return df.select(key, F.explode(found).alias("_v")).select(key, "_v.column", "_v.value")


def table_violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """The fixed rules of a base table, for the columns that are present."""
    allowed = {c: v for (t, c), v in C.ALLOWED_VALUES.items() if t == table and c in df.columns}
    ranges = {"rating": C.RATING_RANGE} if "rating" in df.columns else {}
    return value_violations(df, key, allowed, ranges)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null part is never equal to another."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str = "id") -> DataFrame:
    """Child rows whose set foreign key has no parent."""
    keys = parent.select(F.col(primary).alias(foreign))
    return child.filter(F.col(foreign).isNotNull()).join(keys, foreign, "left_anti")


def cascade_delete(child: DataFrame, parent: DataFrame, foreign: str, primary: str = "id") -> DataFrame:
    """Child rows that stay when rows without a parent are deleted."""
    return child.join(parent.select(F.col(primary).alias(foreign)), foreign, "left_semi")


def set_null_on_delete(child: DataFrame, parent: DataFrame, foreign: str, primary: str = "id") -> DataFrame:
    """All child rows, with a foreign key set to null where its parent is gone."""
    keys = parent.select(F.col(primary).alias(foreign)).dropDuplicates([foreign]).withColumn("_found", F.lit(True))
    out = attach(child, keys, [foreign], "left")
    return out.withColumn(foreign, F.when(F.col("_found"), F.col(foreign))).drop("_found").select(*child.columns)


def date_drift(df: DataFrame, exif: str, modified: str, limit: int = C.EXIF_DRIFT_SECONDS) -> DataFrame:
    return df.withColumn("_d", D.exif_drift(F.col(exif), F.col(modified), limit)).select("*", "_d.*").drop("_d")


def ingested_share(incoming: DataFrame, library: DataFrame, key: str = "sha256") -> DataFrame:
    """One row: files, files already in the library, share, and ``skip / prompt / continue``."""
    known = library.select(key).dropDuplicates([key]).withColumn("_known", F.lit(1))
    share = F.col("already") / F.greatest("files", F.lit(1))
    return (
        attach(incoming.select(key), known, [key], "left")
        .agg(F.count("*").alias("files"), F.count("_known").alias("already"))
        .withColumn("share", share)
        .withColumn(
            "verdict",
            F.when((F.col("files") > 0) & (F.col("already") == F.col("files")), "skip")
            .when(share >= 0.5, "prompt").otherwise("continue"),
        )
    )


def completed_transfers(transfers: DataFrame, drive_hash: str, column: str = "drive_hash") -> DataFrame:
    """How often a drive has been ingested to the end."""
    return transfers.filter((F.col(column) == drive_hash) & (F.col("transfer_status") == "completed")).agg(
        F.count("*").alias("times")
    )
