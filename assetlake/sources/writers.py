"""Sinks. Every sink writes a new path or appends; none overwrites a table that is being read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake import schemas
from assetlake.functions import constants as C
from assetlake.functions import hashes as H
from assetlake.functions import paths as P
from assetlake.operators.sets import union_rows


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_audit_csv(parts: Sequence[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Audit CSV whose header is the sorted union of the columns of all parts."""
    both = union_rows(parts)
    write_csv(both.select(*sorted(both.columns)), path, mode)


def write_summary(one_row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row summary as JSON."""
    one_row.write.mode(mode).json(path, ignoreNullFields=False)


def write_operations(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Operations as JSON lines."""
    manifest.write.mode(mode).json(path, ignoreNullFields=False)


def manifest_documents(manifest: DataFrame, description: str, created: str, per_document: int = 10_000) -> DataFrame:
    """Nested manifest documents ``part, document``.

    A manifest of up to ``per_document`` operations is one document; a longer one is cut by
    operation number, so no document grows with the plan.
    """
    number = F.element_at(F.split("operation_id", "_"), -1).cast("long")
    names = [c.split(" ")[0] for c in schemas.OPERATION.split(", ")]
    docs = manifest.withColumn("part", F.floor((number - 1) / per_document).cast("int")).groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("operations"))
    meta = F.struct(F.lit(created).alias("created"), F.lit("2.0").alias("version"), F.size("operations").cast("long").alias("total_operations"),
                    F.lit(description).alias("description"))
    return docs.select("part", F.to_json(F.struct(meta.alias("metadata"), "operations")).alias("document"))


def write_documents(docs: DataFrame, path: str, column: str = "document", mode: str = "errorifexists") -> None:
    docs.select(column).write.mode(mode).text(path)


def write_checkpoints(records: DataFrame, path: str, run: str) -> None:
    """Checkpoint records of one run, appended as a partition."""
    records.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path, ignoreNullFields=False)


def write_sidecars(sidecars: DataFrame, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Sidecar JSON, one per line, in folders by path hash."""
    b = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    sidecars.select(F.col("sidecar").alias("value"), b.alias("bucket")).write.mode(mode).partitionBy("bucket").text(path)


def sidecar_status(operations: DataFrame, written: DataFrame) -> DataFrame:
    """``path, status`` per operation: written or missing source."""
    done = written.select("path", F.lit("written").alias("status"))
    return operations.select(F.col("original_path").alias("path")).join(done, "path", "left").fillna({"status": "source_missing"})


def json_validity(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines and lines that are not a JSON object. The text is parsed in full."""
    return line_validity(spark.read.text(path))


def line_validity(lines: DataFrame, column: str = "value") -> DataFrame:
    ok = F.try_parse_json(F.col(column)).isNotNull()
    return lines.agg(F.count("*").alias("documents"), F.count_if(~ok).alias("invalid"))


def write_paths(df: DataFrame, path: str, column: str = "path", mode: str = "errorifexists") -> None:
    """A plain list of paths."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_text_files(df: DataFrame, path: str, key: str, text: str) -> int:
    """Each text in a file of its own with a line end after it; returns the number of files.

    A task writes its files into one folder, so folders are as many as tasks and no driver moves files one by one. Rows stand in an
    order in each task, so that a repeated task writes the same files again. A null text is an empty line.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        system, folder = H.file_system(f"{path}/part-{part:05d}")
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{folder}/{n:08d}-{name}.txt", compression=None) as out:
                    out.write(f"{'' if body is None else body}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    spread = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key", "text")
    return spread.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_rows(df: DataFrame, path: str) -> None:
    """Append to an index or log table."""
    df.write.mode("append").parquet(path)


def transfer_log_rows(outcomes: DataFrame, timestamp: str) -> DataFrame:
    """Transfer outcomes in the layout of the transfer log."""
    return outcomes.select(
        F.lit(timestamp).alias("timestamp"), "operation_id", F.col("source_path").alias("source"), F.col("dest_path").alias("destination"),
        P.name(F.col("source_path")).alias("filename"), "size_bytes", "hash_before", "hash_after", "status",
        F.when(F.col("status").isin("VERIFIED", "FAILED"), 1).otherwise(0).alias("attempts"), "error")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those with the same keys."""
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def insert_missing(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` plus the rows whose keys it lacks."""
    return base.unionByName(rows.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def default_settings(spark: SparkSession, values: Mapping[str, str] = C.DEFAULT_SETTINGS) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "key string, value string")
