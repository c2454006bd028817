"""Tables on files that are read in part and changed in part: by month, and by hash buckets of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import pin

MONTH, BUCKET = "month_key", "bucket"


def month_key(when: Column) -> Column:
    """A month as a number, such as 202304."""
    return F.year(when) * 100 + F.month(when)


def write_by_month(df: DataFrame, path: str, when: str = "ingested_date", order: str = "file_path", mode: str = "errorifexists") -> None:
    """A table in one folder per month, sorted by ``order`` in each file.

    A month of many rows is written by many tasks, and small ones together by one, as adaptive execution balances them. Rows without a date have a folder
    of their own.
    """
    placed = df.withColumn(MONTH, month_key(F.col(when))).hint("rebalance", MONTH)
    placed.sortWithinPartitions(MONTH, order).write.mode(mode).partitionBy(MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str, low=None, high=None, when: str = "ingested_date") -> DataFrame:
    """The rows from ``low`` to ``high`` (times, both included); folders of other months are not opened."""
    df = spark.read.parquet(path)
    for limit, side in ((low, "ge"), (high, "le")):
        if limit is not None:
            at = F.lit(limit).cast("timestamp")
            df = df.filter((F.col(MONTH) >= month_key(at)) & (F.col(when) >= at) if side == "ge" else (F.col(MONTH) <= month_key(at)) & (F.col(when) <= at))
    return df


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A table with unique keys in one folder per hash bucket of the key."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_keyed(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], buckets: int = 64, replace: bool = True) -> None:
    """Put the rows of ``updates`` (unique, non-null keys) into a table of ``write_keyed``, in place of those with the same keys or, without ``replace``, only
    where there are none.

    Only buckets that have updates are read, and only their files are replaced. ``buckets`` is that of the table. The new rows are pinned before the old files go, and
    an update that failed half way is simply done again: it gives the same rows.
    """
    new = updates.withColumn(BUCKET, bucket_of(keys, buckets))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most one row per bucket
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
    by = [*keys, BUCKET]
    merged = old.join(new.select(*by), by, "left_anti").unionByName(new, True) if replace else old.unionByName(new.join(old.select(*by), by, "left_anti"), True)
    pin(merged).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
