"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector``, in floats or doubles as given, of the rows with a key and a vector of the table's most common length that
    is not zero and holds only finite numbers. Of equally common lengths the longest counts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector) if plain else F.col(vector).cast("array<double>")
    good = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("vector")).filter(
        F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def bounded_sample(df: DataFrame, vector: str, rows: int) -> np.ndarray:
    """Up to ``rows`` vectors, chosen by a hash of the vector so that every run takes the same ones."""
    n = df.count()
    share = min(1.0, 1.2 * rows / max(n, 1))
    cut = int(share * (1 << 31))
    some = df.select(vector, F.xxhash64(vector).alias("_h")).filter(F.pmod("_h", F.lit(1 << 31)) < cut).orderBy("_h").limit(rows)
    got = some.select(vector).toArrow()
    return matrix(got.column(0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as one matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(whole)
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values.reshape(-1), type=kind))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
