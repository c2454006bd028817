"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from assetlake.operators.duplicates import similar_groups
from assetlake.operators.skew import key_groups, null_safe_join  # noqa: F401
from assetlake.session import pin, tune

# Java's \s has other members than these six, so the set is written out.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def words_in(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over earlier rows, and ``row``, their number, per ``by``.

    Rows are dealt by range of (by, order), so that one key of ``by`` may span many partitions,
    and pinned. A running sum within each partition is shifted by the totals of the partitions
    before it, of which there is one row per key and partition. Rows that tie in the whole order
    are interchangeable. The result depends on the rows only, not on how they were dealt.
    """
    by, order = list(by), list(order)
    sort = [F.col(c).asc_nulls_last() for c in (*by, *order)]
    placed = pin(df.repartitionByRange(*sort)).withColumn("_part", F.spark_partition_id())
    inside = W.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    spans = placed.groupBy("_part", *by).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = spans.select(
        "_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"))
    running = placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn("_at", F.count("*").over(inside))
    if not by:
        # One row per partition.
        shifts = F.broadcast(shifts)
    return null_safe_join(running, shifts, ["_part", *by]).select(
        *df.columns, (F.col("_in") + F.col("_sums")).cast("long").alias("before"), (F.col("_at") + F.col("_rows")).cast("long").alias("row"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: nodes with links, labelled by the smallest node reachable."""
    named = links.select(F.col(a).alias("phash_1"), F.col(b).alias("phash_2"))
    return similar_groups(named).select(F.col("phash").alias("node"), "component")


def shuffled(value: Column, size: Column, seed: Column, rounds: int = 12, inverse: bool = False) -> Column:
    """The place of ``value`` under a pseudorandom permutation of 0 .. size-1 (swap-or-not).

    Each round mirrors the range about a point of its own and swaps a mirrored pair or leaves
    it, by a hash of the pair. A round undoes itself, so the inverse runs them backwards.
    """

    def swap(at: Column, step: Column) -> Column:
        mirrored = F.pmod(F.xxhash64(seed, step) - at, size)
        pair = F.greatest(at, mirrored)
        return F.when(F.xxhash64(seed, pair, step) % 2 == 0, at).otherwise(mirrored)

    steps = F.lit(" ".join(map(str, range(rounds)[::-1 if inverse else 1])))
    return F.aggregate(F.split(steps, " ").cast("array<int>"), value.cast("long"), swap)
