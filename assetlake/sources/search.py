"""Text search over a table on files by an index of trigrams: blocks that cannot have the text are not opened."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.filters import search_text

BLOCK = "search_block"
GRAM = 3
_SCHEMA = f"gram string, {BLOCK} int, gram_bucket int"


def _grams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def _gram_bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add(BLOCK, "integer")).parquet(f"{path}/rows")


def write_searchable(
    df: DataFrame, path: str, columns: Sequence[str], order: str, block_rows: int = 1_000_000, buckets: int = 64,
) -> None:
    """Write ``df`` in blocks of about ``block_rows`` rows in the order of a column, and for each trigram of the lower-cased ``columns`` the blocks
    that have it.

    The list of a trigram is one row per block, so one that every text has stays as short as the number of blocks. Rows that
    are alike in the order column stand in one block.
    """
    blocks = max(math.ceil(df.count() / block_rows), 1)
    df.repartitionByRange(blocks, F.col(order).asc_nulls_first()).withColumn(BLOCK, F.spark_partition_id()).write.partitionBy(BLOCK).parquet(f"{path}/rows")
    # A table without rows leaves no file below rows, so its columns stand apart.
    df.limit(0).write.parquet(f"{path}/columns")
    rows = _rows(df.sparkSession, path)
    found = rows.select(BLOCK, F.explode(F.array(*[F.lower(c) for c in columns])).alias("text")).select(BLOCK, F.explode(_grams(F.col("text"))).alias("gram"))
    lists = found.groupBy("gram", BLOCK).agg(F.count("*").alias("n")).select("gram", BLOCK, _gram_bucket(F.col("gram"), buckets).alias("gram_bucket"))
    lists.repartition("gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").parquet(f"{path}/grams")


def blocks_with(spark: SparkSession, path: str, text: str, buckets: int = 64) -> list[int] | None:
    """The blocks that have every trigram of the text; None if the text is too short to say. At most one number per block."""
    text = text.lower()
    grams = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram string")
    opened = [r[0] for r in asked.select(_gram_bucket(F.col("gram"), buckets)).distinct().collect()]
    lists = spark.read.schema(_SCHEMA).parquet(f"{path}/grams").filter(F.col("gram_bucket").isin(opened) & F.col("gram").isin(grams))
    return sorted(r[0] for r in lists.groupBy(BLOCK).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(BLOCK).collect())


def search(spark: SparkSession, path: str, text: str, columns: Sequence[str], buckets: int = 64) -> DataFrame:
    """The rows of ``write_searchable`` that have the text in one of the columns, in any case, as ``filters.search_text`` finds them.

    Only blocks with all trigrams of the text are opened, and each of their rows is compared. A text of fewer than three
    characters opens all. ``buckets`` is that of the table.
    """
    rows, blocks = _rows(spark, path), blocks_with(spark, path, text, buckets)
    if blocks is not None:
        rows = rows.filter(F.col(BLOCK).isin(blocks))
    return rows.filter(search_text(text, *columns)).drop(BLOCK)
