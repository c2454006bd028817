"""Sorts, limits and pages. Every order ends in a unique column, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def largest_files(df: DataFrame, n: int = 20) -> DataFrame:
    return top(df, n, F.desc("size_bytes"), "path")


def sort_by(df: DataFrame, column: str, descending: bool = False, tie: str = "path") -> DataFrame:
    """Sort by a column of the table; an unknown name is an error."""
    if column not in df.columns:
        raise ValueError(f"unknown sort column {column!r}")
    c = F.desc(column) if descending else F.asc(column)
    return df.orderBy(c, tie) if column != tie else df.orderBy(c)


def _range_of(bounds: list[Row], sort: str, descending: bool, tie: str, kinds: dict[str, DataType]) -> Column:
    """How many of ``bounds`` a row stands at or after. Ascending order has nulls first, descending last.

    The bounds are one list and the row's keys a list of one: written out for each bound, the keys, which may be long
    to work out, would make a plan and code that fill the driver.
    """
    keys = list(dict.fromkeys([sort, tie]))
    made = F.array(*[F.struct(*[F.lit(b[k]).cast(kinds[k]).alias(k) for k in keys]) for b in bounds])

    def after(row: Column, bound: Column, name: str, down: bool) -> Column:
        r, b = row[name], bound[name]
        return F.coalesce(r < b, r.isNull() & b.isNotNull()) if down else F.coalesce(r > b, r.isNotNull() & b.isNull())

    def reached(row: Column, bound: Column) -> Column:
        same = lambda k: row[k].eqNullSafe(bound[k])
        return after(row, bound, sort, descending) | (same(sort) & (after(row, bound, tie, False) | same(tie)))

    return F.transform(F.array(F.struct(*keys)), lambda row: F.size(F.filter(made, lambda bound: reached(row, bound))))[0]


def page(df: DataFrame, number: int, size: int, sort: str = "filename", descending: bool = False,
         tie: str = "path", top_rows: int = 10_000, cuts: int = 63) -> tuple[DataFrame, DataFrame]:
    """One page and a one-row table ``total, total_pages`` of the same rows.

    A page that ends within ``top_rows`` is the tail of a top-k. For a deeper one the place of its first row is narrowed
    down: rows are counted between ``cuts`` of them, chosen by a hash, and only the ranges that the page
    touches are looked at again, until they hold ``top_rows`` or the page itself. So nothing is sorted but those few rows, nothing is
    written, and each further scan has a filter on the order columns. ``tie`` must be unique.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    if sort not in df.columns:
        raise ValueError(f"unknown sort column {sort!r}")
    first = (number - 1) * size
    keys = list(dict.fromkeys([sort, tie]))
    order = [F.desc(sort) if descending else F.asc(sort), *([tie] if tie != sort else [])]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    part, skip, left = df, first, None
    while skip + size > top_rows and left != 0:
        bounds = part.select(*keys).orderBy(F.xxhash64(*keys), *order).limit(cuts).collect()
        index = _range_of(bounds, sort, descending, tie, kinds)
        counts = sorted(part.select(index.alias("range")).groupBy("range").count().collect())
        ends, at = [], 0
        for _, n in counts:
            ends.append((at, at + n))
            at += n
        touched = [(r, a) for (r, _), (a, z) in zip(counts, ends) if a < skip + size and z > skip]
        if not touched or len(touched) == len(counts):
            break
        ranges = [r for r, _ in touched]
        part, skip = part.filter(index.between(ranges[0], ranges[-1])), skip - touched[0][1]
        left = sum(n for r, n in counts if r in ranges) - size
    rows = part.orderBy(*order).offset(skip).limit(size)
    total = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return rows, total


def rank_order(column: Column, *labels: str) -> Column:
    """Sort position of a label in a fixed list."""
    out = F.when(column == labels[0], 1)
    for i, label in enumerate(labels[1:], 2):
        out = out.when(column == label, i)
    return out.otherwise(len(labels) + 1)
