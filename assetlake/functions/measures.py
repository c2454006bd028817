"""Sizes, rates, shares, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions import constants as C


def mib(size: Column, digits: int = 2) -> Column:
    return F.round(size / float(1024**2), digits)


def gib(size: Column, digits: int = 2) -> Column:
    return F.round(size / float(1024**3), digits)


def size_text(size: Column) -> Column:
    """``0 B``, ``1.5 KB`` … with at most two digits; TB is the greatest unit."""
    def fmt(power: int, unit: str) -> Column:
        shown = F.round(size / float(1024**power), 2).cast("decimal(20,2)").cast("string")
        return F.concat(F.regexp_replace(shown, r"\.?0+$", ""), F.lit(f" {unit}"))

    return (
        F.when(size == 0, "0 B")
        .when(size < 1024, fmt(0, "B"))
        .when(size < 1024**2, fmt(1, "KB"))
        .when(size < 1024**3, fmt(2, "MB"))
        .when(size < 1024**4, fmt(3, "GB"))
        .otherwise(fmt(4, "TB"))
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, with a whole of 0 taken as 1."""
    return 100.0 * part / F.greatest(whole, F.lit(1))


def ratio(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den rounded, 0 where den is not positive."""
    return F.when(den > 0, F.round(num / den, digits)).otherwise(F.lit(0.0))


def decimal_degrees(value: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds text (or a plain number) as signed degrees.

    Only text with the word ``deg`` is signed by the hemisphere; null where it cannot be read.
    """
    nums = F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    d, m, s = (F.try_element_at(nums, F.lit(i)).cast("double") for i in (1, 2, 3))
    dms = d + m / 60 + F.coalesce(s, F.lit(0.0)) / 3600
    signed = F.round(F.when(ref.isin("S", "W"), -dms).otherwise(dms), 6)
    plain = F.when(value.rlike(r"^\s*[+-]?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), F.btrim(value).try_cast("double"))
    return F.when(F.contains(value, F.lit("deg")), signed).otherwise(plain)


def frame_rate(text: Column) -> Column:
    """``30000/1001`` as 29.97; null without a ratio or with a zero denominator."""
    parts = F.split(text, "/")
    num, den = (F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2))
    return F.when((F.size(parts) == 2) & (den != 0), F.round(num / den, 2))


def space_check(required_bytes: Column, free_bytes: Column, margin: float = C.SPACE_MARGIN) -> Column:
    """Struct ``passed, required_gb, available_gb, surplus_gb, deficit_gb``."""
    g = float(1024**3)
    need, have = required_bytes / g * margin, free_bytes / g
    return F.struct(
        (have >= need).alias("passed"),
        F.round(need, 2).alias("required_gb"),
        F.round(have, 2).alias("available_gb"),
        F.round(have - need, 2).alias("surplus_gb"),
        F.when(have < need, F.round(need - have, 2)).alias("deficit_gb"),
    )
