"""Path columns: pieces, prefixes, globs, MIME types."""

from __future__ import annotations

import mimetypes
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions import constants as C


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Suffix with its dot; empty for none and for a name that only starts with a dot."""
    return F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1)


def suffix_lower(path: Column) -> Column:
    return F.lower(suffix(path))


def stem(path: Column) -> Column:
    n = name(path)
    return F.substr(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    up = F.substr(path, F.lit(1), F.length(path) - F.length(name(path)) - 1)
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit("."))
        .when(up == "", F.lit("/"))
        .otherwise(up)
    )


def without_suffix(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(suffix(path)))


def join_path(folder: Column, leaf: Column) -> Column:
    return F.when(folder == "/", F.concat(folder, leaf)).otherwise(F.concat_ws("/", folder, leaf))


def media_class(extension: Column) -> Column:
    """IMAGE, VIDEO or OTHER by suffix, in any case."""
    e = F.lower(extension)
    return (
        F.when(e.isin(*C.IMAGE_SUFFIXES), "IMAGE").when(e.isin(*C.VIDEO_SUFFIXES), "VIDEO").otherwise("OTHER")
    )


def mime_type(path: Column) -> Column:
    """MIME type by suffix from the standard table, ``application/octet-stream`` otherwise."""
    table = mimetypes.MimeTypes()
    lookup = F.create_map(*[F.lit(x) for kv in sorted(table.types_map[True].items()) for x in kv])
    base = F.lower(name(path))
    for short, full in sorted(mimetypes.MimeTypes().suffix_map.items()):
        base = F.when(F.endswith(base, F.lit(short)), F.replace(base, F.lit(short), F.lit(full))).otherwise(base)
    packed = "|".join(sorted(k[1:].lower() for k in table.encodings_map))
    base = F.regexp_replace(base, rf"\.({packed})$", "")
    return F.coalesce(F.try_element_at(lookup, suffix(base)), F.lit("application/octet-stream"))


def relative_to(path: Column, root: str | Column) -> Column:
    """Path below the root, or the bare name when it lies elsewhere."""
    r = F.lit(root.rstrip("/")) if isinstance(root, str) else F.regexp_replace(root, "/$", "")
    inside = F.startswith(path, F.concat(r, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(r) + 2)).otherwise(name(path))


def keep_priority(path: Column, root_prefix: str | None = None,
                  markers: Sequence[tuple[str, int]] = C.KEEP_PRIORITY) -> Column:
    """Keep priority of a copy: organised folders first, unknown places last."""
    out = None
    for mark, rank in markers:
        hit = F.contains(path, F.lit(mark))
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    if root_prefix:
        out = out.when(F.startswith(path, F.lit(root_prefix)), C.KEEP_PRIORITY_ROOT)
    return out.otherwise(C.KEEP_PRIORITY_OTHER)


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ``**/`` any folders, ``*`` within one name, and a
    trailing slash everything below the folder."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.+()[]{}^$|" else glob[i]), i + 1
    return f"^{out}{'.*' if glob.endswith('/') else ''}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Any glob matches, in any case."""
    joined = "|".join(f"(?:{glob_pattern(g)})" for g in globs)
    return F.lower(path).rlike(joined.lower())


def selected(path: Column, include: Sequence[str] = C.BACKUP_INCLUDE,
             exclude: Sequence[str] = C.BACKUP_EXCLUDE) -> Column:
    """Included and not excluded; exclusion wins."""
    hit = matches_any(path, include)
    return hit & ~matches_any(path, exclude) if exclude else hit


def library_destination(file_class: Column, taken: Column, is_screenshot: Column | None = None) -> Column:
    """Library folder: class root, then year and month, or the unknown-date folder."""
    root = (
        F.when(file_class == "VIDEO", C.VIDEOS_ROOT)
        .when(file_class.isin("IMAGE", "RAW", "JPG"), C.PHOTOS_ROOT)
        .otherwise(C.PROJECTS_ROOT)
    )
    dated = F.when(taken.isNull(), F.lit(C.UNKNOWN_DATE_FOLDER)).otherwise(F.date_format(taken, "yyyy/MM"))
    out = F.concat_ws("/", root, dated)
    if is_screenshot is not None:
        out = F.when(is_screenshot, F.concat_ws("/", root, F.lit(C.SCREENSHOTS_FOLDER))).otherwise(out)
    return out
