"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import prefix_sums
from assetlake.session import pin


def byte_size(text: str):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row, shards 0 .. shards-1 near equal in bytes.

    The rows get one global order, the totals of the partitions before a row give its byte
    position, and equal targets cut that line; a row falls to the shard that holds its middle.
    The order is a hash of the text, then the key: contiguous runs are a random sample of the
    sources, and equal texts lie together, so that only a group at a cut is divided. Only keys,
    sizes and hashes are moved, never texts, and the key splits a group of any size.

    A null text has size 1 and no checksum; an empty one size 1 and checksum 0. Null and
    repeated keys are kept, each with a slot. Other columns are ignored. No rows give no rows.
    """
    # Pinned, so that the texts are read once and not also to sample the order.
    rows = pin(docs.select(
        F.col(key).alias("key"), byte_size(text).alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash")))
    placed = prefix_sums(rows, ["hash", "text_crc32", "size", "key"], "size")
    total = rows.agg(F.sum("size")).first()[0] or 1
    # In decimals: twice the bytes of a very large corpus times the shards may pass a long.
    middle = (F.col("before").cast("decimal(38,0)") * 2 + F.col("size")) * shards
    cut = placed.withColumn("shard", F.floor(middle / F.lit(2 * total)).cast("int"))
    # One row per shard.
    starts = F.broadcast(cut.groupBy("shard").agg(F.min("row").alias("first")))
    return cut.join(starts, "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
