"""Deterministic sharded WARC archives, and reading them back."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm.common import prefix_sums
from assetlake.operators.skew import attach
from assetlake.session import pin

LEAST_PAYLOAD = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
_READ = "record_type string, page_id long, uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_ORDER = ["_none", "_id", "_digest"]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as executors see it: local, HDFS or an object store."""
    return pafs.FileSystem.from_uri(path)


def _rename(fs: pafs.FileSystem, old: str, new: str) -> None:
    if fs.get_file_info(new).type != pafs.FileType.NotFound:
        (fs.delete_dir if fs.get_file_info(new).type == pafs.FileType.Directory else fs.delete_file)(new)
    fs.move(old, new)


def record(kind: str, page_id: int | None, uri: str | None, digest: str, payload: bytes, copy: int, refers_to: int | None, date: str) -> bytes:
    """One record: headers and digests are made anew from the payload and the key."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = lambda page, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{n}')}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id, copy)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + (re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else f"urn:page:{page_id}"),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to, 0)}", f"X-Refers-To-Page: {refers_to}"] if kind == "revisit" else []
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """The files of one shard: a new one once the compressed size is reached."""

    def __init__(self, root: str, shard: int, limit: int, level: int):
        self.fs, self.root = _open(root)
        self.shard, self.limit, self.level, self.part, self.out = shard, limit, level, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            # Named by attempt, so that two attempts never write the same file.
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.sum, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        packer = zlib.compressobj(self.level, wbits=31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + 1
        if self.bytes >= self.limit:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        _rename(self.fs, self.temporary, f"{self.root}/{self.name}")
        self.part += 1
        return self.name, self.shard, self.part - 1, self.records, self.bytes, self.sum.hexdigest()


def _keys(pages: DataFrame, key: str, text: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return pages.withColumns({
        "_none": F.col(key).isNull().cast("int"), "_id": F.coalesce(F.col(key), F.lit(0)).cast("long"), "_digest": digest,
        "_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", text: str = "html", file_bytes: int | None = None,
    shard_bytes: int = 16 << 20, most_shards: int = 100_000, date: str = "2024-01-01T00:00:00Z", level: int = 5,
) -> DataFrame:
    """Write a record per page below ``path`` and return the manifest, one row per file.

    Shards are cut at equal bytes of the pages in order of key and digest, whatever the input's
    partitions, and sorted; so the same pages give the same files, byte for byte. The least
    shard is ``shard_bytes``; a large input gets ``most_shards`` larger ones, the bound of what
    the driver and each task hold of their limits. Files roll at ``file_bytes`` compressed, by default
    an eighth of the bytes of a shard, so that a shard is several files unless its pages shrink to less. A
    file appears under its name when it is whole, and the manifest under its own when all are;
    then the temporary folder goes, with what failed attempts left there.

    Of pages with equal payloads of 100 bytes or more the smallest key is the response and the
    others are revisits, found from keys and digests alone. A null payload is empty. A page
    without key is a response. Repeated rows of one key are revisits of the first where the
    payload allows. An empty input has an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    keyed = _keys(pages.select(key, uri, text), key, text)
    small = pin(keyed.select(*_ORDER, F.col("_bytes"), (F.col("_bytes") + 700).alias("_size")))
    large = small.filter((F.col("_bytes") >= LEAST_PAYLOAD) & (F.col("_none") == 0))
    firsts = large.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    revisits = attach(large, firsts, ["_digest"]).filter("_id > _first").select(*_ORDER, "_first").distinct()

    placed = prefix_sums(small, _ORDER, "_size")
    total = small.agg(F.sum("_size")).first()[0] or 0
    least = max(shard_bytes, -(-total // most_shards))
    roll_at = file_bytes or max(least // 8, 1)
    # One row per shard, of which there are at most most_shards.
    cuts = placed.groupBy(F.floor(F.col("before") / least)).agg(F.min(F.struct(*_ORDER)).alias("k")).select("k.*").collect()
    limits = sorted(tuple(r) for r in cuts)

    @F.pandas_udf("int")
    def shard_of(none: pd.Series, ids: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([max(bisect.bisect_right(limits, k) - 1, 0) for k in zip(none, ids, digest)], dtype="int32")

    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = keyed.select(*_ORDER, F.lit(1).alias("_kind"), empty("long", "_first"), F.col(uri).alias("uri"), F.col(text).alias("text")).unionByName(
        revisits.select(*_ORDER, F.lit(0).alias("_kind"), "_first", empty("string", "uri"), empty("string", "text")))
    dealt = rows.withColumn("_shard", shard_of(*_ORDER)).repartitionById(max(len(limits), 1), F.col("_shard")).sortWithinPartitions(
        "_shard", *_ORDER, "_kind", "uri")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last, copy, refers = None, None, 0, None
        done: list[tuple] = []
        for batch in batches:
            for none, ident, digest, kind, first, at, body, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if roll is None or roll.shard != shard:
                    done += [roll.close()] if roll and roll.out else []
                    roll = _Roll(path, shard, roll_at, level)
                if (none, ident, digest) != last:
                    last, copy, refers = (none, ident, digest), 0, None
                if kind == 0:  # comes before the pages it is about
                    refers = first
                    continue
                payload = (body or "").encode()
                page = None if none else ident
                target = refers if refers is not None else page if copy and page is not None and len(payload) >= LEAST_PAYLOAD else None
                done += roll.add(record("response" if target is None else "revisit", page, at, digest, payload, copy, target, date))
                copy += 1
        done += [roll.close()] if roll and roll.out else []
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "part", "records", "bytes", "sha256"), d)) for d in done], schema=pa.schema([
            ("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    fs, root = _open(path)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    attempt = f"_manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/{attempt}")
    _rename(fs, f"{root}/{attempt}", f"{root}/_manifest")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")


def _records(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """The records of one file; each is a compressed member of its own."""
    with fs.open_input_stream(path, compression=None) as source:
        member, parts, data = zlib.decompressobj(31), [], source.read(1 << 20)
        while data:
            parts.append(member.decompress(data))
            data = member.unused_data
            if member.eof:
                yield b"".join(parts)
                member, parts = zlib.decompressobj(31), []
            data = data or source.read(1 << 20)
        if parts:
            raise ValueError(f"{path} ends within a record")


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    size = None if payload is None else len(payload)
    return kind, page and int(page), fields["WARC-Target-URI"], digest, size, refers and int(refers), payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the files that the manifest names; digests are checked.

    A revisit has its response's size by a join on the response's key and digest, which splits a
    response with very many revisits. ``payload`` is null for revisits, or without ``payloads``.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")
    files = manifest.select("file", "records", "bytes")
    tasks = max(manifest.select("shard").distinct().count(), 1)  # as many as wrote
    names = ["record_type", "page_id", "uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for data in _records(fs, f"{root}/{name}"):
                    row = _parse(data)
                    rows.append(dict(zip(names, row if payloads else (*row[:-1], None))))
                    held += len(data) if payloads else 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = files.repartitionByRange(tasks, "file").mapInArrow(read, _READ)
    response = found.filter("record_type = 'response'")
    sizes = response.filter("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    # Spark takes records for as small as the manifest they come from, and would broadcast them.
    sizes = sizes.hint("merge")
    revisit = found.filter("record_type = 'revisit'").withColumn("_page", F.col("page_id")).withColumn("page_id", F.col("refers_to"))
    sized = attach(revisit, sizes, ["page_id", "payload_digest"], "left").withColumn("page_id", F.col("_page")).withColumn("payload_bytes", F.col("_bytes"))
    return response.unionByName(sized.select(*response.columns))
