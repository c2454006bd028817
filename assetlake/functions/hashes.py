"""Content hashes and perceptual hashes."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import Column
from pyspark.sql import functions as F

SCREEN_BYTES = 1024 * 1024


def content_hashes(content: Column) -> list[Column]:
    return [F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256")]


def quick_hash(content: Column, first: int = SCREEN_BYTES) -> Column:
    """SHA-256 of the first bytes, for screening."""
    return F.sha2(F.substring(content.cast("binary"), 1, first), 256)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its name there. A path with a scheme is a name, not an encoded address: a blank or a percent sign in it stands for itself."""
    scheme, sign, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@[]')}") if sign else (pafs.LocalFileSystem(), path)


def file_hashes(path: str, first: int | None = None, chunk: int = 4 << 20) -> tuple[str | None, str | None, str | None]:
    """MD5 and SHA-256 of a file, or of its first bytes, in chunks; or the error in their place, whatever it is."""
    md5, sha256, left = hashlib.md5(), hashlib.sha256(), first
    try:
        system, name = file_system(path)
        with system.open_input_stream(name, compression=None) as source:
            while data := source.read(chunk if left is None else min(chunk, left)):
                md5.update(data)
                sha256.update(data)
                left = None if left is None else left - len(data)
    except Exception as e:  # noqa: BLE001  what one file does wrong must not end the job
        return None, None, f"{type(e).__name__}: {e}"[:500]
    return md5.hexdigest(), sha256.hexdigest(), None


def hash_head(h: Column, n: int = 32) -> Column:
    return F.substring(h, 1, n)


def average_bits(pixels: Column) -> Column:
    """One bit per grey value: 1 where it is above the mean."""
    nums = pixels.cast("array<double>")
    mean = F.aggregate(nums, F.lit(0.0), lambda a, x: a + x) / F.size(nums)
    # In a list of one, or Spark would work out the mean anew for each value.
    once = F.array(F.struct(nums.alias("v"), mean.alias("m")))
    return F.transform(once, lambda p: F.array_join(F.transform(p["v"], lambda v: F.when(v > p["m"], "1").otherwise("0")), ""))[0]


def bits_to_hex(bits: Column) -> Column:
    """Hex digits of a bit string whose length is a multiple of 4."""
    starts = F.sequence(F.lit(0), F.floor((F.length(bits) - 1) / 64).cast("int"))
    def chunk(i: Column) -> Column:
        piece = F.substr(bits, i * 64 + 1, F.lit(64))
        return F.lpad(F.lower(F.conv(piece, 2, 16)), F.ceil(F.length(piece) / 4).cast("int"), F.lit("0"))
    return F.array_join(F.transform(starts, chunk), "")


def average_hash(pixels: Column) -> Column:
    return bits_to_hex(average_bits(pixels))


def hex_to_bits(h: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.length(h) - 1) / 16).cast("int"))
    def chunk(i: Column) -> Column:
        piece = F.substr(h, i * 16 + 1, F.lit(16))
        return F.lpad(F.conv(piece, 16, 2), (F.length(piece) * 4).cast("int"), F.lit("0"))
    return F.array_join(F.transform(starts, chunk), "")


def hash_words(h: Column) -> Column:
    """A hex hash as signed 64-bit words."""
    starts = F.sequence(F.lit(0), F.floor((F.length(h) - 1) / 16).cast("int"))
    return F.transform(starts, lambda i: F.conv(F.substr(h, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))


def word_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )


def hamming(h1: Column, h2: Column) -> Column:
    """Differing bits of two hex hashes; null when lengths differ or one is not hex."""
    ok = (F.length(h1) == F.length(h2)) & h1.rlike("^[0-9a-fA-F]+$") & h2.rlike("^[0-9a-fA-F]+$")
    return F.when(ok, word_distance(hash_words(h1), hash_words(h2)))


def similarity(distance: Column, bits: int | Column) -> Column:
    return 1.0 - distance / bits
