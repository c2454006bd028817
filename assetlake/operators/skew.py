"""Building blocks for groups of any size.

A key may hold a third of all rows, so no helper here sorts or collects a whole group in
one task:

* ``best_per_key`` reduces before the shuffle,
* ``attach`` joins a one-row-per-key table back; the adaptive skew join splits heavy keys,
* ``number_rows`` numbers a sorted table without a one-partition window,
* ``row_blocks`` cuts a sorted table into blocks of bounded rows, within keys too,
* ``running_total`` and ``carry_forward`` run ordered logic over bounded blocks and pass
  only one row per block between them,
* ``member_lists`` writes a long list as several bounded rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from assetlake.session import pin


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores after it as it takes to be no column of the tables."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equal names where null matches null; key columns come from the left."""
    tmp = {k: f"_r_{k}" for k in keys}
    on = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(tmp[k]))
        on = cond if on is None else on & cond
    return left.join(right.withColumnsRenamed(tmp), on, how).drop(*tmp.values())


def best_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str],
    latest: bool = False, extra: Sequence[Column] = (),
) -> DataFrame:
    """The first (or last) row of each key in the given order, as a partial aggregate.

    ``order`` must end in a unique column so the pick does not depend on the task order.
    """
    ranks = [_col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    row = F.struct(*ranks, *[F.col(k) for k in keep])
    pick = (F.max if latest else F.min)(row).alias("_best")
    out = df.groupBy(*keys).agg(pick, *extra)
    kept = [c for c in out.columns if c not in (*keys, "_best")]
    return out.select(*keys, *[F.col(f"_best.{k}").alias(k) for k in keep], *kept)


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join a table with one row per key back to its rows, where a key may be very heavy.

    The adaptive skew join splits a heavy shuffle partition of ``df`` over many tasks, but only
    between two plain shuffles. A ``per_key`` table that comes out of an aggregate is already
    partitioned by the key and would join without a shuffle of its own, and so without the
    split. The second join key, a hash of the keys, asks for one: the small side is shuffled
    again and the heavy side can be split.
    """
    j = free_name("_j", df, per_key)
    left = df.withColumn(j, F.xxhash64(*keys))
    right = per_key.withColumn(j, F.xxhash64(*keys))
    out = null_safe_join(left, right, [*keys, j], how) if null_safe else left.join(right, [*keys, j], how)
    return out.drop(j)


def number_rows(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "seq",
) -> DataFrame:
    """``row_number`` from 1, restarting per ``by``, for groups of any size.

    The rows are range-partitioned and sorted on (by, order), so one key can span many
    partitions. They are then pinned by a reliable checkpoint, and the position in the
    partition is shifted by the rows of the same key in earlier partitions: one summary row
    per key and partition. The order must end in a unique column.
    """
    by = list(by)
    keys = [F.col(b) for b in by]
    cols = df.columns
    sort = [F.col(b).asc_nulls_first() for b in by] + [_col(c) for c in order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = pin(ranged).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    spans = placed.groupBy("_part", *by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    # One row per key and partition: at most the number of partitions per key.
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select(
        "_part", *by,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    if not by:
        # One row per partition.
        offsets = F.broadcast(offsets)
    return null_safe_join(placed, offsets, ["_part", *by]).select(
        *cols, (F.col("_pos") + F.col("_shift") + 1).cast("long").alias(name)
    )


def running_total(
    df: DataFrame, by: Sequence[str], block: str, order: Sequence[str | Column], value: str | Column, name: str,
) -> DataFrame:
    """Running sum per key where ``block`` is a coarse, order-preserving cut of the order
    columns (such as the day of a time). Windows see one block of one key at a time."""
    by = list(by)
    inner = W.partitionBy(*by, block).orderBy(*[_col(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    blocks = df.groupBy(*by, block).agg(F.sum(_col(value)).alias("_sum"))
    prior = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*by, block, F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_carry"))
    return (
        null_safe_join(df.withColumn("_in", F.sum(_col(value)).over(inner)), carried, [*by, block])
        .withColumn(name, F.col("_in") + F.col("_carry"))
        .drop("_in", "_carry")
    )


def carry_forward(
    df: DataFrame, by: Sequence[str], block: str, order: Sequence[str], value: str, name: str,
) -> DataFrame:
    """The last non-null ``value`` of the key strictly before each row, in blocks."""
    by = list(by)
    stamp = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = df.groupBy(*by, block).agg(F.max_by(value, stamp).alias("_end"))
    prior = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, block, F.last("_end", ignorenulls=True).over(prior).alias("_carry"))
    inner = W.partitionBy(*by, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        null_safe_join(df.withColumn("_in", F.last(value, ignorenulls=True).over(inner)), carried, [*by, block])
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_in", "_carry")
    )


def row_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_block", block_rows: int = 1_000_000) -> DataFrame:
    """Adds a block number: blocks of about ``block_rows`` rows, ascending by (by, order) whatever the rows of a key.

    Few rows are one block as they stand. More are dealt by range and pinned, so that a later scan sees the same blocks:
    what a window computes in one (key, block) is carried over blocks by one row for each. The order should be
    unique per key; equal rows stand in one block.
    """
    blocks = math.ceil(df.count() / block_rows)
    if blocks <= 1:
        return df.withColumn(name, F.lit(0))
    ranged = df.repartitionByRange(blocks, *[F.col(c).asc_nulls_first() for c in (*by, *order)])
    return pin(ranged).withColumn(name, F.spark_partition_id())


def part_number(value: str | Column, parts: str | Column) -> Column:
    """A part 0..parts-1 chosen by the MD5 of the value, the same in any engine."""
    head = F.conv(F.substring(F.md5(_col(value)), 1, 8), 16, 10).cast("long")
    return F.pmod(head, _col(parts)).cast("int")


def member_lists(df: DataFrame, key: str, value: str, part_rows: int = 10_000) -> DataFrame:
    """Sorted member lists per key: ``key, part, parts, members``.

    A group of up to ``part_rows`` members is one row with the whole list. A larger one is
    cut into parts of about that size, so that no row or task holds an unbounded list; all
    members are kept.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count(value) / part_rows).cast("int").alias("parts"))
    return (
        attach(df.select(key, value), sizes, [key])
        .withColumn("part", part_number(value, F.greatest("parts", F.lit(1))))
        .groupBy(key, "part")
        .agg(F.max("parts").alias("parts"), F.sort_array(F.collect_list(value)).alias("members"))
        .select(key, "part", "parts", "members")
    )


def key_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches sorted by the keys (numbers without nulls)."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        starts = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(found)]
        for a, b in zip(starts, starts[1:]):
            if waiting and tuple(found[a]) != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = tuple(found[a])
    if waiting:
        yield pa.Table.from_batches(waiting)
