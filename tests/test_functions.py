"""Scalar functions: worked examples and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assetlake.functions import dates as D
from assetlake.functions import hashes as H
from assetlake.functions import measures as M
from assetlake.functions import names as N
from assetlake.functions import paths as P


def values(spark, rows, schema, col):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_path_pieces(spark):
    rows = [("/a/b.tar.gz",), ("/a/.hidden",), ("/top",), ("plain.JPG",), ("/a/b/none",)]
    p = F.col("p")
    assert values(spark, rows, "p string", P.suffix(p)) == [".gz", "", "", ".JPG", ""]
    assert values(spark, rows, "p string", P.stem(p)) == ["b.tar", ".hidden", "top", "plain", "none"]
    assert values(spark, rows, "p string", P.parent(p)) == ["/a", "/a", "/", ".", "/a/b"]


def test_mime(spark):
    rows = [("/x/a.JPG",), ("/x/a.tar.gz",), ("/x/a.gz",), ("/x/a.nosuch",), ("/x/a.mp4",)]
    assert values(spark, rows, "p string", P.mime_type(F.col("p"))) == [
        "image/jpeg", "application/x-tar", "application/octet-stream", "application/octet-stream", "video/mp4"]


def test_globs(spark):
    rows = [("/d/a.NEF",), ("/d/.b.jpg",), ("/d/.git/c.jpg",), ("/d/e.tmp",), ("/d/f.jpg",), ("/d/node_modules/g.jpg",)]
    assert values(spark, rows, "p string", P.selected(F.col("p"))) == [True, False, False, False, True, False]


def test_relative(spark):
    rows = [("/root/a/b.jpg",), ("/rooted/c.jpg",)]
    assert values(spark, rows, "p string", P.relative_to(F.col("p"), "/root/")) == ["a/b.jpg", "c.jpg"]


def test_dates(spark):
    rows = [("2022:08:10 10:03:43",), ("2022-08-10T04:03:43.410000",), ("2022-08-10 04:03:43",), ("2022-08-10T23:30:00+05:00",), ("2022-08-10T23:30:00Z",),
            ("2022-08-10",), ("12:30",), ("2022",), ("junk",), ("",), (None,)]
    got = values(spark, rows, "s string", F.date_format(D.parse_taken(F.col("s")), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2022-08-10 10:03:43", "2022-08-10 04:03:43", "2022-08-10 04:03:43", "2022-08-10 23:30:00", "2022-08-10 23:30:00", "2022-08-10 00:00:00",
                   None, None, None, None, None]


def test_exif_text(spark):
    rows = [("2022:08:10 10:03:43",), ("2022:08:10",), ("a b c:d",), ("",)]
    assert values(spark, rows, "s string", D.exif_to_iso_text(F.col("s"))) == ["2022-08-10T10:03:43", "2022:08:10", "a b c:d", None]


def test_report_month_strict(spark):
    rows = [("2022:08:10 10:03:43",), ("2022-09-10T04:03:43",), ("2022-10-01 junk",)]
    assert values(spark, rows, "s string", D.report_month(F.col("s"), strict=True)) == [None, "2022-09", "2022-10"]
    assert values(spark, rows, "s string", D.report_month(F.col("s"))) == ["2022-08", "2022-09", None]


def test_drift_limits(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=s), base) for s in (7200, 7201, -7200)] + [(None, base)]
    got = values(spark, rows, "e timestamp, m timestamp", D.exif_drift(F.col("e"), F.col("m")))
    assert [(r.valid, r.action) for r in got] == [
        (True, "use_exif_date"), (False, "flag_for_review"), (True, "use_exif_date"), (False, "use_file_mtime")]


def test_heartbeat_limits(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(now - dt.timedelta(seconds=s),) for s in (29, 30, 59, 60)] + [(None,)]
    assert values(spark, rows, "t timestamp", D.heartbeat_health(F.col("t"), F.lit(now))) == ["healthy", "warning", "warning", "critical", "unknown"]


def test_duration_text(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(now, now + dt.timedelta(seconds=s)) for s in (59, 60, 3661)] + [(None, now)]
    assert values(spark, rows, "a timestamp, b timestamp", D.duration_text(F.col("a"), F.col("b"))) == ["59s", "1m 0s", "1h 1m", "N/A"]


def test_camera_short(spark):
    rows = [("Nikon D850",), ("nikon d850",), ("NIKON D750",), ("Acme Model  X9 ",), ("",), (None,), ("   ",)]
    assert values(spark, rows, "c string", N.camera_short(F.col("c"))) == ["D850", "D850", "D750", "X9", "UNK", "UNK", "UNK"]


def test_photo_name(spark):
    taken = D.parse_taken(F.lit("2025:03:15 14:30:22"))
    got = values(spark, [(1,)], "n int", N.dated_name(taken, N.camera_short(F.lit("Nikon D850")), F.col("n"), F.lit(".jpg")))
    assert got == ["2025-03-15_14-30-22_D850_0001.jpg"]


def test_template_fallbacks(spark):
    none = F.lit(None).cast("string")
    no_time = F.lit(None).cast("timestamp")
    got = values(spark, [("/a/My Pic?.JPG",)], "p string", N.template_name(
        "{YYYY}-{MM}-{DD}_{camera_make}_{original_name}_{sequence}_{nope}", F.col("p"), no_time, no_time, F.lit(7), none, none, none, none, none))
    assert got == ["NODATE-01-01_Unknown_My_Pic__007.JPG"]


@pytest.mark.parametrize("text,want", [("{x}a<b>c", "a_b_c"), ("  a \t b  ", "a_b"), ("..name_.", "name"), ("a/b\\c|d", "a_b_c_d")])
def test_sanitise(spark, text, want):
    assert values(spark, [(text,)], "s string", N.sanitise(F.col("s"))) == [want]


def test_labels(spark):
    assert values(spark, [("Scan of RECEIPT 12",), ("my passport",), ("photo",)], "s string", N.document_type(F.col("s"))) == ["invoice", "id_document", "Document"]
    assert values(spark, [("Screenshot of Mac",), ("Shot",)], "s string", N.screenshot_device(F.col("s"))) == ["Mac", "Unknown"]
    assert values(spark, [(3840, 2160), (10, 20)], "w int, h int", N.resolution_short(F.col("w"), F.col("h"))) == ["4K", "10x20"]


def test_clean_characters(spark):
    assert values(spark, [("é ñ:x*",)], "s string", N.clean_characters(F.col("s"))) == ["e_n-x-"]
    assert values(spark, [("a" * 300,)], "s string", F.length(N.clean_characters(F.col("s")))) == [200]


def test_sizes(spark):
    rows = [(0,), (1,), (1023,), (1024,), (1536,), (1024**2,), (5 * 1024**3 + 1,), (3 * 1024**4,)]
    assert values(spark, rows, "n long", M.size_text(F.col("n"))) == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5 GB", "3 TB"]


def test_space_check(spark):
    g = 1024**3
    r = values(spark, [(int(5.55 * g), int(369.82 * g) + 1), (10 * g, 12 * g)], "a long, b long", M.space_check(F.col("a"), F.col("b")))
    assert (r[0].passed, r[0].required_gb, r[0].available_gb, r[0].surplus_gb, r[0].deficit_gb) == (True, 8.32, 369.82, 361.5, None)
    assert (r[1].passed, r[1].deficit_gb) == (False, 3.0)


def test_degrees(spark):
    rows = [("51 deg 23' 12.34\" N", "N"), ("51 deg 23' 12.34\" W", "W"), ("-12.5", "S"), ("junk", "N"), (None, "N")]
    assert values(spark, rows, "v string, r string", M.decimal_degrees(F.col("v"), F.col("r"))) == [51.386761, -51.386761, -12.5, None, None]


def test_frame_rate(spark):
    assert values(spark, [("30000/1001",), ("25/0",), ("25",), ("",)], "s string", M.frame_rate(F.col("s"))) == [29.97, None, None, None]


def test_hamming(spark):
    rows = [("ff00", "ff01"), ("ffffffffffffffff", "0000000000000000"), ("0" * 32 + "f" * 32, "f" * 64), ("ff", "fff"), ("zz", "00"), (None, "00")]
    assert values(spark, rows, "a string, b string", H.hamming(F.col("a"), F.col("b"))) == [1, 64, 128, None, None, None]


def test_average_hash(spark):
    df = spark.createDataFrame([([float(i) for i in range(1024)],), ([0.0, 10.0, 0.0, 10.0] * 256,)], "px array<double>")
    got = [r[0] for r in df.select(H.average_hash(F.col("px"))).collect()]
    assert got == ["0" * 128 + "f" * 128, "5" * 256]
    back = df.select(H.hex_to_bits(H.average_hash(F.col("px"))) == H.average_bits(F.col("px")))
    assert all(r[0] for r in back.collect())
