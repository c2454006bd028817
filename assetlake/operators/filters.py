"""Row filters over inventories, assets and logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import dates as D


@dataclass(frozen=True)
class AssetFilter:
    """Criteria of an asset search; only the ones that are set apply."""

    camera: str | None = None
    date_from: str | datetime | None = None
    date_to: str | datetime | None = None
    size_min: int | None = None
    size_max: int | None = None
    name_contains: str | None = None
    text: str | None = None
    kind: str | None = None


def like_pattern(text: str) -> str:
    """A LIKE pattern that finds the text itself, with its wildcards escaped."""
    for ch in ("\\", "%", "_"):
        text = text.replace(ch, "\\" + ch)
    return f"%{text}%"


def filter_assets(
    df: DataFrame, f: AssetFilter, camera: str = "camera_model", date: str = "created_at", size: str = "size_bytes",
    name: str = "filename", path: str = "path", kind: str = "file_type",
) -> DataFrame:
    if f.camera:
        df = df.filter(F.col(camera) == f.camera)
    if f.date_from:
        df = df.filter(F.col(date) >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to:
        df = df.filter(F.col(date) <= F.lit(f.date_to).cast("timestamp"))
    if f.size_min:
        df = df.filter(F.col(size) >= f.size_min)
    if f.size_max:
        df = df.filter(F.col(size) <= f.size_max)
    if f.name_contains:
        # LIKE of the reference engine ignores case.
        df = df.filter(F.lower(name).like(like_pattern(f.name_contains.lower())))
    if f.text:
        df = df.filter(search_text(f.text, name, path, camera))
    if f.kind:
        df = df.filter(F.col(kind) == f.kind)
    return df


def search_text(text: str, *columns: str) -> Column:
    """The text occurs in any of the columns, in any case; a null column never matches."""
    q, out = F.lit(text.lower()), F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return out


def with_status(df: DataFrame, states: Sequence[str] = C.ACTIVE_STATES, column: str = "status") -> DataFrame:
    return df.filter(F.upper(column).isin(*[s.upper() for s in states]))


def by_suffix(df: DataFrame, suffixes: Sequence[str], column: str = "extension") -> DataFrame:
    return df.filter(F.lower(column).isin(*[s.lower() for s in suffixes]))


def _blank(c: str) -> Column:
    v = F.col(c).cast("string")
    return v.isNull() | v.isin("", "0", "0.0")


def missing_metadata(df: DataFrame) -> DataFrame:
    """Images without date, make and model; videos without duration, codec and frame rate.
    Only the columns that exist are looked at."""
    def all_blank(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            if n in df.columns:
                out = out & _blank(n)
        return out

    kind = F.col("file_type")
    return df.filter(
        ((kind == "IMAGE") & all_blank("date_taken", "camera_make", "camera_model"))
        | ((kind == "VIDEO") & all_blank("duration", "codec", "fps"))
    )


def newer_than(df: DataFrame, as_of: str, hours: float = 24, column: str = "timestamp") -> DataFrame:
    """Rows whose time text lies within the last hours; unreadable times are dropped."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)"))
    return df.filter(D.parse_taken(F.col(column)) >= cutoff)


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def not_like(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    for p in patterns:
        df = df.filter(~F.col(column).like(p))
    return df


def under(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def edited_images(develop: DataFrame) -> DataFrame:
    return develop.filter(F.col("exposure").isNotNull() | F.col("cropTop").isNotNull())


def expired_archive(df: DataFrame, as_of: str, days: int = C.ARCHIVE_DAYS, column: str = "archived_at") -> DataFrame:
    return df.filter(F.datediff(F.lit(as_of).cast("date"), F.col(column)) > days)
