"""Date columns. The reference time is always a parameter, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions import constants as C


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def parse_taken(text: Column) -> Column:
    """EXIF (``2022:08:10 10:03:43``) or ISO text as a timestamp, null for anything else.

    A zone offset is dropped, so the wall-clock time of the camera is kept.
    """
    exif = F.try_to_timestamp(text, F.lit("yyyy:M:d H:m:s"))
    wall = F.regexp_replace(text, r"(?<=\d)(Z|[+-]\d{2}:?\d{2})$", "")
    wall = F.when(F.length(text) > 10, wall).otherwise(text)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(wall))
    return F.coalesce(exif, iso)


def exif_to_iso_text(text: Column) -> Column:
    """EXIF date text in ISO form; other text is unchanged, empty text is null."""
    parts = F.split(text, " ")
    two = F.contains(text, F.lit(":")) & (F.size(parts) == 2)
    iso = F.concat(F.replace(parts[0], F.lit(":"), F.lit("-")), F.lit("T"), parts[1])
    return F.when(text == "", None).when(two, iso).otherwise(text)


def first_present(*texts: Column) -> Column:
    """First text that is neither null nor empty, whether or not it parses."""
    return F.coalesce(*[_present(t) for t in texts])


def first_parsed(*texts: Column) -> Column:
    """First text that parses as a date."""
    return F.coalesce(*[parse_taken(t) for t in texts])


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def report_month(text: Column, strict: bool = False) -> Column:
    """Month of a date text. ``strict`` accepts ISO forms only and drops EXIF dates."""
    if strict:
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), month_key(parse_taken(F.when(
            F.contains(text, F.lit("T")), text).otherwise(F.substring(text, 1, 10)))))
    return month_key(parse_taken(text))


def months_before(as_of: Column, months: int) -> Column:
    return F.add_months(as_of.cast("date"), -months)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6


def duration_text(start: Column, end: Column) -> Column:
    """``12s``, ``3m 20s`` or ``2h 5m``; ``N/A`` without a start."""
    s = F.floor(seconds_between(start, end)).cast("long")
    return (
        F.when(start.isNull(), "N/A")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def backup_phase(modified: Column, as_of: Column) -> Column:
    """1 recent, 2 working, 3 archive, by age in days."""
    age = F.datediff(as_of, modified)
    return F.when(age <= C.PHASE_DAYS[0], 1).when(age <= C.PHASE_DAYS[1], 2).otherwise(3)


def to_utc(ts: Column, zone: str = C.CAMERA_TIME_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def exif_drift(exif: Column, modified: Column, limit: int = C.EXIF_DRIFT_SECONDS) -> Column:
    """Struct ``valid, reason, action`` of an EXIF time against the file time."""
    gap = F.abs(seconds_between(modified, exif))
    return F.struct(
        (exif.isNotNull() & (gap <= limit)).alias("valid"),
        F.when(exif.isNull(), "No EXIF date")
        .when(gap > limit, F.format_string("Timezone drift detected (%.1f hours)", gap / 3600))
        .alias("reason"),
        F.when(exif.isNull(), "use_file_mtime")
        .when(gap > limit, "flag_for_review")
        .otherwise("use_exif_date")
        .alias("action"),
    )


def heartbeat_health(last_beat: Column, as_of: Column) -> Column:
    age = seconds_between(last_beat, as_of)
    return (
        F.when(last_beat.isNull(), "unknown").when(age < 30, "healthy").when(age < 60, "warning").otherwise("critical")
    )
