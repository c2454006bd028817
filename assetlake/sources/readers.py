"""Sources: file scans, audit tables, manifests, catalogs, metadata exports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from assetlake import schemas
from assetlake.functions import constants as C
from assetlake.functions import documents as J
from assetlake.functions import hashes as H
from assetlake.functions import paths as P


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def scan_files(spark: SparkSession, root: str, recursive: bool = True, suffixes: Sequence[str] | None = None) -> DataFrame:
    """Files below a root with size and time; the content is not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    p = _plain(F.col("path"))
    df = raw.select(
        p.alias("path"), P.name(p).alias("filename"), P.suffix_lower(p).alias("extension"), F.col("length").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("created"), F.col("modificationTime").alias("modified"),
        P.media_class(P.suffix(p)).alias("file_type"), P.mime_type(p).alias("mime_type"))
    return df.filter(F.col("extension").isin(*[s.lower() for s in suffixes])) if suffixes else df


def scan_roots(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of several roots with ``folder_index``, and a table of roots that do not exist."""
    found, missing = None, []
    for i, root in enumerate(roots):
        try:
            one = scan_files(spark, root, True, suffixes).withColumn("folder_index", F.lit(i))
        except AnalysisException:
            missing.append((root, "Folder does not exist"))
            continue
        found = one if found is None else found.unionByName(one)
    errors = spark.createDataFrame(missing, "path string, error string")
    if found is None:
        raise FileNotFoundError("none of the roots exists")
    return found, errors


def add_hashes(files: DataFrame, path: str = "path", first: int | None = None, opened=None) -> DataFrame:
    """The rows with ``md5, sha256, error`` of the file behind each path, or of its ``first`` bytes.

    A file of any size is read in chunks of a few MB, through its own file system, by the task that
    has its path; contents never enter a row. A file that cannot be read gets an error and no
    hashes. ``opened``, an accumulator, counts the files that were opened.
    """
    spark = files.sparkSession
    at = files.columns.index(path)
    added = [T.StructField(n, T.StringType()) for n in ("md5", "sha256", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [H.file_hashes(name, first) for name in batch.column(at).to_pylist()]
            if opened is not None:
                opened.add(len(made))
            columns = [pa.array(c, pa.string()) for c in zip(*made)] if made else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "md5", "sha256", "error"])

    # Paths are short and files are not: the number of tasks must not follow the bytes of the paths.
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    return spread.mapInArrow(run, T.StructType([*files.schema.fields, *added]))


def hash_files(spark: SparkSession, root: str, known: DataFrame | None = None, opened=None) -> DataFrame:
    """``path, size_bytes, modified, md5, sha256, error`` of each file below a root.

    ``known`` (``path, size_bytes, modified, md5, sha256``) is a store of earlier hashes: a file
    with the same path, size and time is taken from it and not opened.
    """
    listed = scan_files(spark, root).select("path", "size_bytes", "modified")
    if known is None:
        return add_hashes(listed, opened=opened)
    same, keys = known.select("path", "size_bytes", "modified", "md5", "sha256"), ["path", "size_bytes", "modified"]
    kept = listed.join(same, keys).withColumn("error", F.lit(None).cast("string"))
    return add_hashes(listed.join(same, keys, "left_anti"), opened=opened).unionByName(kept)


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """Audit CSV by header name. Empty text is missing; absent columns are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=False)
    return to_inventory(raw)


def to_inventory(raw: DataFrame) -> DataFrame:
    """Bring text columns to the inventory schema, in any column order."""
    out = []
    for part in schemas.INVENTORY.split(", "):
        name, kind = part.split(" ")
        c = F.nullif(F.col(name).cast("string"), F.lit("")).try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        out.append(c.alias(name))
    return raw.select(*out)


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit data from CSV or JSON, chosen by the suffix of the path."""
    low = path.rstrip("/").lower()
    if low.endswith(".csv"):
        return read_audit_csv(spark, path)
    if low.endswith(".json"):
        # Values arrive as text or numbers; both are read as text and typed afterwards.
        rec = ", ".join(f"{part.split(' ')[0]}:string" for part in schemas.INVENTORY.split(", "))
        # Each file is read once as a text; a file may hold a document or a list of them.
        docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<file_records:array<struct<{rec}>>>>")).alias("d"))
        return to_inventory(docs.select(F.explode("d.file_records").alias("r")).select("r.*"))
    raise ValueError(f"audit data must be .csv or .json: {path}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Operations of manifest documents, with their position."""
    doc = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    return doc.select(F.posexplode("operations").alias("position", "op")).select("position", "op.*")


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """Operations written as JSON lines."""
    return spark.read.schema(schemas.OPERATION).json(path)


def newest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """The newest checkpoint document of a folder, by file time and then name."""
    raw = spark.read.schema(schemas.CHECKPOINT_STATE).json(folder, multiLine=True)
    order = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"))
    cols = [c.split(" ")[0] for c in schemas.CHECKPOINT_STATE.split(", ")]
    return raw.agg(F.max_by(F.struct(*cols), order).alias("s")).filter("s is not null").select("s.*")


def register_tables(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> list[str]:
    """Make the library's Parquet tables available to ``spark.sql`` under their names."""
    done = []
    for name in names or schemas.TABLES:
        try:
            df = spark.read.schema(schemas.TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}") if name in schemas.TABLES else spark.read.parquet(
                f"{folder.rstrip('/')}/{name}")
        except AnalysisException:
            if names:
                raise
            continue
        df.createOrReplaceTempView(name)
        done.append(name)
    return done


def read_database(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 16) -> DataFrame:
    """A table of a database over JDBC; filters and column choices go to the database.

    With a number, date or time ``column`` (best the key) the table is read by ``parts`` tasks, each a range of equal width between the column's least and
    greatest value, which the database finds; nulls are in the first. Without one it is one task's work.
    """
    source = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=10_000)
    if column is None:
        return source.load()
    low, high = source.load().agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return source.load()
    return source.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=parts).load()


def read_catalogs(
    spark: SparkSession, catalogs: Mapping[str, str], table: str, column: str | None = None, parts: int = 16,
) -> DataFrame:
    """One table of several catalogs, with ``catalog_path``: Parquet folders or JDBC addresses, which are read as by ``read_database``."""
    out = None
    for catalog, place in catalogs.items():
        if place.startswith("jdbc:"):
            df = read_database(spark, place, table, column, parts)
        else:
            df = spark.read.parquet(f"{place.rstrip('/')}/{table}")
        df = df.withColumn("catalog_path", F.lit(catalog))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    """Normalised camera metadata from an EXIF export with one JSON record per line."""
    return parse_exif(spark.read.text(path))


def parse_exif(lines: DataFrame, column: str = "value") -> DataFrame:
    rec = F.from_json(F.col(column), J.EXIF_RECORD)
    return lines.select(rec.alias("r")).filter("r.SourceFile is not null").select(F.col("r.SourceFile").alias("path"), J.exif_metadata(F.col("r")).alias("m")).select("path", "m.*")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Video metadata from probe results with one JSON record per line."""
    return parse_probe(spark.read.text(path))


def parse_probe(lines: DataFrame, column: str = "value") -> DataFrame:
    rec = F.from_json(F.col(column), J.PROBE_RECORD)
    return lines.select(rec.alias("r")).filter("r.path is not null").select("r.path", J.probe_metadata(F.col("r")).alias("m")).select("path", "m.*")


def watch_folder(spark: SparkSession, folder: str, suffixes: Sequence[str] = C.IMAGE_SUFFIXES + C.VIDEO_SUFFIXES,
                 max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream, with hashes by the same reader as ``hash_files``."""
    raw = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
        .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    )
    p = _plain(F.col("path"))
    listed = raw.filter(P.suffix_lower(p).isin(*suffixes)).select(
        p.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), P.media_class(P.suffix(p)).alias("file_type"))
    return add_hashes(listed)
