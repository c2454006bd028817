"""Inventories compared folder by folder: digests of folders and trees decide which files need a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import paths as P
from assetlake.operators.joins import compare_backup
from assetlake.operators.skew import attach
from assetlake.session import pin

WORDS = 8
_SUMS = [f"sum_{i}" for i in range(WORDS)]


def _leaf(path: str) -> Column:
    """SHA-256 of a file's path, content hash and size, each ended by a line feed after its length, so that no two rows spell the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (path, "sha256", "size_bytes")]
    return F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p, F.lit("\n"))]), 256)


def folder_digests(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """``folder, files, sum_0 .. sum_7``: a digest of the files that stand directly in each folder.

    ``files`` has the path, ``sha256`` and ``size_bytes``. The digest is the sum of the files' SHA-256 values, word by word, and their number:
    it does not depend on the order, counts repeated rows, and adds up in parts before the shuffle, so a folder of any
    size is never a list. A word has 28 bits, and its sum stays a long up to 2^35 files. Files at the top have the folder "".
    """
    leaf = files.select(P.parent(F.col(path)).alias("folder"), _leaf(path).alias("leaf")).withColumn(
        "folder", F.when(F.col("folder").isin(".", "/"), "").otherwise(F.coalesce("folder", F.lit(""))))
    words = [F.conv(F.substring("leaf", 7 * i + 1, 7), 16, 10).cast("long") for i in range(WORDS)]
    return leaf.groupBy("folder").agg(F.count("*").alias("files"), *[F.sum(w).alias(n) for w, n in zip(words, _SUMS)])


def tree_digests(folders: DataFrame) -> DataFrame:
    """``folder_digests`` of whole trees: every folder with all below it, the top as "".

    Sums of sums, from the table of folders alone: one row per folder and ancestor, whatever the number of files.
    """
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    ancestors = F.array_distinct(F.concat(F.array(F.lit("")), above))
    return folders.withColumn("folder", F.explode(ancestors)).groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("files", *_SUMS)])


def compare_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """``folder, files_1, files_2, same`` of two tables of digests; a folder that one side lacks has no files there."""
    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select("folder", F.col("files").alias(f"files_{n}"), F.struct("files", *_SUMS).alias(f"digest_{n}"))

    return side(a, 1).join(side(b, 2), "folder", "full_outer").select(
        "folder", *[F.coalesce(f"files_{n}", F.lit(0)).alias(f"files_{n}") for n in (1, 2)],
        F.coalesce(F.col("digest_1") == F.col("digest_2"), F.lit(False)).alias("same"))


def _hashed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sha256") != "").select("rel_path", "sha256", "size_bytes")


def compare_trees(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """``compare_digests`` of all trees of a library and its backup, rows without a hash apart."""
    return compare_digests(*[tree_digests(folder_digests(_hashed(df))) for df in (primary, backup)])


def compare_backup_by_folder(primary: DataFrame, backup: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """``joins.compare_backup`` where files are joined only in folders whose digests differ.

    Paths are unique on each side and not null. The files of a folder that is the same on both sides are verified as they stand, without a
    shuffle. The differing folders are few after most copies: up to ``most_broadcast`` of them are sent
    to the tasks, and more are joined to the files by folder, where a folder of very many files is split.
    """
    a, b = _hashed(primary), _hashed(backup)
    apart = pin(compare_digests(folder_digests(a), folder_digests(b)).filter("not same").select("folder", F.lit(True).alias("apart")))
    small = apart.limit(most_broadcast + 1).count() <= most_broadcast

    def placed(df: DataFrame) -> DataFrame:
        at = P.parent(F.col("rel_path"))
        rows = df.withColumn("folder", F.when(at.isin(".", "/"), "").otherwise(F.coalesce(at, F.lit(""))))
        return rows.join(F.broadcast(apart), "folder", "left") if small else attach(rows, apart.hint("merge"), ["folder"], "left")

    a, b = placed(a), placed(b)
    whole = a.filter("apart is null").select(
        "rel_path", F.col("sha256").alias("primary_hash"), F.col("size_bytes").alias("primary_size"),
        F.col("sha256").alias("backup_hash"), F.col("size_bytes").alias("backup_size"), F.lit("verified").alias("outcome"))
    return whole.unionByName(compare_backup(a.filter("apart"), b.filter("apart")))
