"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import components
from assetlake.operators.skew import attach
from assetlake.session import pin

SEED = 42
HALF = 32
_LOW = (1 << HALF) - 1


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; without words zero.

    Bytes are lower-cased and split as ASCII, which leaves other characters as they are.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(parts) - words + 1, 1)
    ends = ends[words - 1:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    count, some = np.zeros(64, dtype=np.int64), 65_536
    for at in range(0, n, some):
        # In blocks, so that a very long text needs no more memory than its bytes.
        cuts = zip(starts[at: min(at + some, n)].tolist(), ends[at: at + some].tolist())
        hashes = np.array([digest(line[i:j], SEED) for i, j in cuts], dtype="<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * count > n).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fp, hash`` with the fingerprint as a signed long and ``__hash`` carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), batch.column(2)], [key, "fp", "hash"])

    return docs.select(F.col(key).cast("long").alias(key), text, "__hash").mapInArrow(run, f"`{key}` long, fp long, hash long")


def _flips(part: Column) -> Column:
    """The values one bit away, up to that pair's own order: only zero bits are set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: F.lit(1).cast("long") * F.pow(F.lit(2.0), b).cast("long"))
    return F.transform(F.filter(bits, lambda m: part.bitwiseAND(m) == 0), lambda m: part.bitwiseOR(m))


def near_pairs(prints: DataFrame) -> DataFrame:
    """``a < b`` (as fingerprints met, each pair once) of distinct fingerprints with 1 or 2 differing bits.

    The fingerprint has two halves. If two differ in at most two bits, either the high halves differ in
    at most one bit, or they differ in two and the low halves are equal. So a table of high halves
    is probed with the ball of radius one and a table of low halves with the value itself. Two
    high halves one bit apart meet at the value that has the bit. Every meeting is verified on all 64
    bits within the join. With 32-bit keys a fingerprint meets few others by chance even among
    billions; a half that very many share is split by the adaptive skew join.
    """
    high, low = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit(_LOW))
    zero = F.lit(0)
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("value"))
    stored = prints.select(F.col("fp").alias("b"), F.explode(F.array(one(0, high), one(1, low))).alias("k")).select("b", "k.*")
    ball = F.transform(_flips(high), lambda v: F.struct(zero.alias("kind"), v.cast("long").alias("value")))
    probes = prints.select(F.col("fp").alias("a"), F.explode(F.concat(F.array(one(0, high), one(1, low)), ball)).alias("k")).select("a", "k.*")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    across = F.bit_count(F.shiftrightunsigned(apart, HALF))
    # A pair with equal high halves is met from both sides, as is one with equal low halves.
    once = F.when(F.col("kind") == 0, (across == 1) | (F.col("a") < F.col("b"))).otherwise((across == 2) & (F.col("a") < F.col("b")))
    met = probes.join(stored, ["kind", "value"]).filter((F.bit_count(apart) <= 2) & (F.col("a") != F.col("b")) & once)
    return met.select("a", "b")


def _grouped(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, fp, hash, component, component_id`` per row; the component is named by its least fingerprint."""
    marked = pin(fingerprints(docs.withColumn("__hash", F.xxhash64(text)), key, text, words))
    classes = pin(marked.groupBy("fp").agg(F.min(key).alias("_least")))
    linked = components(near_pairs(classes), "a", "b")
    ids = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = ids.groupBy("component").agg(F.min("_least").alias("component_id"))
    labels = attach(ids.select("fp", "component"), least, ["component"]).select("fp", "component", "component_id")
    return attach(marked, labels, ["fp"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fp, component_id`` per row: fingerprints at two bits or fewer link.

    All rows of a fingerprint are one class under its smallest key; classes are linked, not
    rows, so a group of copies of any size makes one class. ``component_id`` is the smallest key
    reachable. A null or empty text has fingerprint zero and links like any other. Rows with a null key
    keep their fingerprint; a component with null keys alone has a null id. Repeated rows stay.
    """
    return _grouped(docs, key, text, words).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row of ``docs`` for every group of near duplicates: the least key, null keys last.

    The row is fetched by hashes of its key and text. A row repeated in both stays once.
    """
    last = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("hash").alias("hash"))
    chosen = _grouped(docs, key, text, words).groupBy("component").agg(F.min(last).alias("_best")).select(
        F.xxhash64("_best.key", "_best.hash").alias("__row"), F.col("_best.hash").alias("__hash"))
    rows = docs.withColumns({"__hash": F.xxhash64(text)}).withColumn("__row", F.xxhash64(F.col(key).cast("long"), "__hash"))
    return rows.join(chosen, ["__row", "__hash"], "left_semi").dropDuplicates(["__row", "__hash"]).select(*docs.columns)
