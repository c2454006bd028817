"""JSON columns and nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import measures as M
from assetlake.functions import names as N
from assetlake.functions import paths as P


def parse_map(text: Column) -> Column:
    """JSON object as a string map, empty where it is missing or broken."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def build_json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def has_keyword(json_array: Column, keyword: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(json_array, "array<string>"), keyword), F.lit(False))


EXIF_RECORD = (
    "SourceFile string, Make string, CameraMake string, Model string, CameraModel string, LensModel string, Lens string, "
    "DateTimeOriginal string, CreateDate string, FocalLength string, ISO string, FNumber string, "
    "ApertureValue string, ShutterSpeedValue string, ExposureTime string, GPSLatitude string, "
    "GPSLatitudeRef string, GPSLongitude string, GPSLongitudeRef string"
)

PROBE_RECORD = (
    "path string, format struct<duration:string, bit_rate:string, tags:struct<creation_time:string>>, "
    "streams array<struct<codec_type:string, codec_name:string, width:int, height:int, r_frame_rate:string>>"
)


def exif_metadata(rec: Column) -> Column:
    """Normalised metadata struct of one EXIF record, with the usual fall-back fields."""
    def first(*fields: str) -> Column:
        return F.coalesce(*[rec[f] for f in fields])

    return F.struct(
        first("Make", "CameraMake").alias("camera_make"),
        first("Model", "CameraModel").alias("camera_model"),
        first("LensModel", "Lens").alias("lens_model"),
        D.exif_to_iso_text(first("DateTimeOriginal", "CreateDate")).alias("date_taken"),
        N.focal_text(rec["FocalLength"]).alias("focal_length"),
        rec["ISO"].try_cast("int").alias("iso"),
        first("FNumber", "ApertureValue").alias("aperture"),
        N.shutter_text(first("ShutterSpeedValue", "ExposureTime")).alias("shutter_speed"),
        M.decimal_degrees(rec["GPSLatitude"], F.coalesce(rec["GPSLatitudeRef"], F.lit("N"))).alias("gps_latitude"),
        M.decimal_degrees(rec["GPSLongitude"], F.coalesce(rec["GPSLongitudeRef"], F.lit("W"))).alias("gps_longitude"),
    )


def probe_metadata(rec: Column) -> Column:
    """Video struct of one probe record; the first video stream counts."""
    video = F.try_element_at(F.filter(rec["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    return F.struct(
        rec["format"]["duration"].try_cast("double").alias("duration"),
        video["codec_name"].alias("codec"),
        video["width"].alias("width"),
        video["height"].alias("height"),
        M.frame_rate(video["r_frame_rate"]).alias("fps"),
        rec["format"]["bit_rate"].try_cast("long").alias("bitrate"),
        rec["format"]["tags"]["creation_time"].alias("creation_time"),
    )


def transfer_sidecar(path: Column, new_name: Column, sha256: Column, metadata: Column,
                     operation: Column, created: Column) -> Column:
    """Sidecar with metadata and transfer information."""
    return F.struct(
        F.lit("1.0").alias("version"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
        P.name(path).alias("original_filename"),
        path.alias("original_path"),
        new_name.alias("new_filename"),
        F.concat(F.lit("sha256:"), sha256).alias("unique_id"),
        metadata.alias("metadata"),
        F.struct(
            operation.alias("operation_id"),
            F.lit(None).cast("string").alias("transferred_at"),
            F.lit(None).cast("string").alias("verified_hash"),
        ).alias("transfer_info"),
    )


def planned_sidecar(sequence: Column, path: Column, new_name: Column, sha256: Column, size: Column,
                    metadata: Column, created: Column) -> Column:
    """Sidecar with original, planned and transfer parts."""
    return F.struct(
        F.format_string("SC_%05d", sequence).alias("sidecar_id"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
        F.struct(
            P.name(path).alias("filename"), path.alias("path"), sha256.alias("hash"), size.alias("size")
        ).alias("original"),
        F.struct(new_name.alias("filename"), F.lit(None).cast("string").alias("path")).alias("planned"),
        metadata.alias("metadata"),
        F.struct(
            F.lit("pending").alias("status"), F.lit(None).cast("string").alias("started_at"),
            F.lit(None).cast("string").alias("completed_at"), F.lit(False).alias("verified"),
        ).alias("transfer"),
    )
