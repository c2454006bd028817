"""File naming: camera short names, templates, sanitising, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions import constants as C
from assetlake.functions import paths as P


def lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def full_camera(make: Column, model: Column) -> Column:
    return F.btrim(F.concat_ws(" ", F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))))


def camera_short(camera: Column, table: Mapping[str, str] = C.CAMERA_SHORT) -> Column:
    """Short camera name: exact entry, entry in any case, last word, or UNK."""
    folded = lookup({k.lower(): v for k, v in reversed(table.items())}, F.lower(camera))
    words = F.filter(F.split(camera, r"\s+"), lambda w: w != "")
    return F.coalesce(lookup(table, camera), folded, F.try_element_at(words, F.lit(-1)), F.lit("UNK"))


def dated_name(taken: Column, camera: Column, sequence: Column, suffix: Column) -> Column:
    """``2025-03-15_14-30-22_D850_0001.jpg``"""
    return F.concat(
        F.date_format(taken, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"), camera, F.lit("_"),
        F.format_string("%04d", sequence), suffix,
    )


def rename_reason(suffix: Column, taken: Column) -> Column:
    return (
        F.when(~F.lower(suffix).isin(*C.PHOTO_SUFFIXES), "not_photo").when(taken.isNull(), "no_date").otherwise("ok")
    )


def sanitise(text: Column) -> Column:
    """Drop leftover tokens, replace unsafe characters, collapse blanks, trim the ends."""
    text = F.regexp_replace(text, r"\{[^}]+\}", "")
    text = F.regexp_replace(text, r'[<>:"/\\|?*]', "_")
    text = F.regexp_replace(text, r"\s+", "_")
    return F.btrim(text, F.lit("_. "))


def template_name(
    pattern: str | Column, path: Column, taken: Column, modified: Column, sequence: Column,
    make: Column, model: Column, lens: Column, iso: Column, focal: Column,
) -> Column:
    """Expand the tokens of a naming pattern and sanitise the result.

    Date tokens use the capture time, else the file time, else fixed fillers.
    """
    when = F.coalesce(taken, modified)

    def or_text(c: Column, other: str) -> Column:
        return F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit(other))

    def worded(c: Column) -> Column:
        return F.replace(or_text(c, "Unknown"), F.lit(" "), F.lit("_"))

    values = {
        "{YYYY}": F.coalesce(F.date_format(when, "yyyy"), F.lit("NODATE")),
        "{MM}": F.coalesce(F.date_format(when, "MM"), F.lit("01")),
        "{DD}": F.coalesce(F.date_format(when, "dd"), F.lit("01")),
        "{HH}": F.coalesce(F.date_format(when, "HH"), F.lit("00")),
        "{mm}": F.coalesce(F.date_format(when, "mm"), F.lit("00")),
        "{ss}": F.coalesce(F.date_format(when, "ss"), F.lit("00")),
        "{camera_make}": worded(make),
        "{camera_model}": worded(model),
        "{lens_model}": worded(lens),
        "{sequence}": F.format_string("%03d", sequence),
        "{original_name}": P.stem(path),
        "{original_ext}": P.suffix(path),
        "{iso}": or_text(iso, "0"),
        "{focal_length}": or_text(focal, "0"),
    }
    out = F.lit(pattern) if isinstance(pattern, str) else pattern
    for token, value in values.items():
        out = F.replace(out, F.lit(token), value)

    def with_suffix(name: Column) -> Column:
        ends = F.endswith(F.lower(name), P.suffix_lower(path))
        return F.nullif(F.when(ends, name).otherwise(F.concat(name, P.suffix(path))), F.lit(""))

    # The one-element array names the long expression once, so it is not evaluated per use.
    return F.transform(F.array(sanitise(out)), with_suffix)[0]


def clean_characters(text: Column, remove_accents: bool = True, max_length: int = C.NAME_MAX_LENGTH) -> Column:
    """Replace unsafe characters, drop accents, cut to the greatest length."""
    old, new = "".join(C.NAME_REPLACEMENTS), "".join(C.NAME_REPLACEMENTS.values())
    text = F.translate(text, old, new)
    if remove_accents:
        text = F.translate(text, ACCENTED, PLAIN)
    return F.substring(text, 1, max_length)


# Accented Latin letters and their plain letters.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def with_hash(file_name: Column, sha256: Column, conflict: Column, digits: int = 8) -> Column:
    """Append the first digits of the content hash to the stem where the name conflicts."""
    tagged = F.concat(P.stem(file_name), F.lit("_"), F.substring(sha256, 1, digits), P.suffix(file_name))
    return F.when(conflict, tagged).otherwise(file_name)


def resolution_short(width: Column, height: Column) -> Column:
    size = F.concat_ws("x", width.cast("string"), height.cast("string"))
    return F.coalesce(lookup(C.RESOLUTION_SHORT, size), size)


def device_short(camera: Column) -> Column:
    return F.coalesce(lookup(C.DEVICE_SHORT, camera), F.lit(C.SCREENSHOT_DEFAULT))


def document_type(text: Column, whole_numbers: bool = False) -> Column:
    """First document class with one of its words anywhere in the text, in any case.

    With ``whole_numbers`` a digit at an end of a word (``1099``, ``w2``) must also end the number in the text, as the
    counter of ``IMG_001099`` names no form.
    """
    low, out = F.lower(text), None
    for label, words in C.DOCUMENT_WORDS.items():
        if whole_numbers:
            words = [("(?<![0-9])" if w[0].isdigit() else "") + w + ("(?![0-9])" if w[-1].isdigit() else "") for w in words]
        hit = low.rlike("|".join(words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(C.DOCUMENT_DEFAULT)


def screenshot_device(file_name: Column) -> Column:
    out = None
    for pattern, device in C.SCREENSHOT_DEVICES.items():
        hit = file_name.rlike(pattern)
        out = F.when(hit, device) if out is None else out.when(hit, device)
    return out.otherwise(C.SCREENSHOT_DEFAULT)


def naming_pattern(path: Column, has_gps: Column | None = None) -> Column:
    """Naming pattern of the first rule whose words occur in the path."""
    low, out = F.lower(path), None
    for words, pattern in C.PATTERN_BY_WORDS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, pattern) if out is None else out.when(hit, pattern)
    if has_gps is not None:
        out = out.when(has_gps, C.PATTERN_WITH_GPS)
    return out.otherwise(C.PATTERN_DEFAULT)


def operation_id(stamp: str | Column, sequence: Column) -> Column:
    s = F.lit(stamp) if isinstance(stamp, str) else stamp
    return F.format_string("OP_%s_%04d", s, sequence)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def focal_text(value: Column) -> Column:
    return F.concat(F.btrim(F.replace(value.cast("string"), F.lit(" mm"), F.lit(""))), F.lit(" mm"))


def shutter_text(value: Column) -> Column:
    return value.cast("string")
