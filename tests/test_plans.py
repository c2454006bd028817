"""Rename, transfer and reconciliation plans on small frames."""

from pyspark.sql import functions as F

from assetlake.operators import aggregates as A
from assetlake.operators import joins as J
from assetlake.operators import tasks as T
from assetlake.plans import rename as R
from assetlake.plans import transfer as X

FILES = "path string, date_taken string, modified string, camera_make string, camera_model string"


def test_audit_plan_numbers_only_photos(spark):
    rows = [("/a/x.JPG", "2025:03:15 14:30:22", "", "Nikon", "D850"), ("/a/b.txt", "2025:03:15 14:30:20", "", "", ""),
            ("/a/y.jpg", "2025:03:15 14:30:23", "", "Nikon", "D850"), ("/a/z.nef", "", "2025-03-16T01:00:00", None, None), ("/a/n.jpg", "junk", "", "", "")]
    got = {r.old_path: (r.new_path, r.reason) for r in R.audit_plan(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        "/a/x.JPG": ("/a/2025-03-15_14-30-22_D850_0001.jpg", "rename_jpg"), "/a/y.jpg": ("/a/2025-03-15_14-30-23_D850_0002.jpg", "rename_jpg"),
        "/a/z.nef": ("/a/2025-03-16_01-00-00_UNK_0001.nef", "rename_nef")}
    s = R.audit_plan_statistics(spark.createDataFrame(rows, FILES), R.audit_plan(spark.createDataFrame(rows, FILES))).first()
    assert (s.total, s.renamed, s.skipped_not_photo, s.skipped_no_date, s.conflicts) == (5, 3, 1, 1, 0)


def test_audit_plan_flags_conflicts(spark):
    rows = [("/a/x.jpg", "2025:03:15 14:30:22", "", "", "A"), ("/a/y.JPG", "2025:03:15 14:30:22", "", "", "B")]
    files = spark.createDataFrame(rows, FILES).withColumn("camera_model", F.lit("Same"))
    plan = R.audit_plan(files, reset_on=("date_key", "path"))
    assert sorted(r.conflict_check for r in plan.collect()) == ["CONFLICT", "ok"]
    hashes = spark.createDataFrame([("/a/x.jpg", "a" * 64), ("/a/y.JPG", "b" * 64)], "path string, sha256 string")
    names = {r.new_path for r in R.resolve_conflicts(plan, hashes).collect()}
    assert len(names) == 2 and any("_bbbbbbbb" in n for n in names)


def test_pair_shares_name(spark):
    rows = [("/a/DSC_1.NEF", "2025:03:15 14:30:22", "", "Nikon", "Nikon D850"), ("/a/DSC_1.JPG", "2025:03:15 14:30:22", "", "Nikon", "Nikon D850"),
            ("/a/DSC_2.JPEG", "2025:03:15 14:30:22", "", "Nikon", "Nikon D850"), ("/a/DSC_2.NEF", "2025:03:15 14:30:22", "", "Nikon", "Nikon D850")]
    got = {r.source: (r.new_name, r.pair_base) for r in R.template_plan(spark.createDataFrame(rows, FILES), "{YYYY}_{sequence}").collect()}
    assert got["/a/DSC_1.NEF"] == ("2025_001.NEF", "/a/DSC_1") and got["/a/DSC_1.JPG"] == ("2025_001.JPG", "/a/DSC_1")
    assert got["/a/DSC_2.JPEG"] == ("2025_002.JPEG", None) and got["/a/DSC_2.NEF"] == ("2025_003.NEF", None)


def test_template_conflicts(spark):
    rows = [("/a/1.jpg", "2025:03:15 14:30:22", "", "", ""), ("/b/2.jpg", "2025:03:15 14:30:22", "", "", ""), ("/a/2025.jpg", "2024:01:01 00:00:00", "", "", "")]
    df = spark.createDataFrame(rows, FILES)
    got = {r.source: (r.new_name, r.renamed, r.conflict) for r in R.template_plan(df, "{YYYY}", df).collect()}
    assert got["/a/1.jpg"] == ("2025.jpg", True, "file_exists") and got["/b/2.jpg"] == ("2025.jpg", True, "duplicate_name")
    assert got["/a/2025.jpg"] == ("2024.jpg", True, None)


def test_burst_names(spark):
    rows = [(f"/a/IMG_100{i}.CR2", "2025:03:15 14:30:22", "", "Nikon", "D850") for i in (1, 2, 3)]
    got = sorted(r.new_path for r in R.burst_plan(spark.createDataFrame(rows, FILES)).collect())
    assert got == [f"/a/2025-03-15_14-30-22_D850_burst1_000{i}.cr2" for i in (1, 2, 3)]


def test_document_name(spark):
    df = spark.createDataFrame([("/d/scan0001_invoice.pdf", "2025-03-15", "", "b7e2f1a9cc")], "path string, date_taken string, modified string, sha256 string")
    assert R.document_plan(df).first().new_path == "/d/2025-03-15_Invoice_scan0001_invoice_b7e2f1a9.pdf"


def test_transfer_outcomes(spark):
    ops = spark.createDataFrame([(k, f"/s/{k}", f"/d/{k}", e) for k, e in (
        ("gone", ""), ("same", ""), ("same2", "h"), ("wrong", "zzz"), ("new", ""), ("bad", ""), ("lost", ""))], "operation_id string, source_path string, dest_path string, expected_hash string")
    inv = "path string, sha256 string, size_bytes long"
    src = spark.createDataFrame([(f"/s/{k}", "h", 3) for k in ("same", "same2", "wrong", "new", "bad", "lost")], inv)
    before = spark.createDataFrame([("/d/same", "h", 3), ("/d/same2", "h", 3)], inv)
    after = spark.createDataFrame([("/d/new", "h", 3), ("/d/bad", "x", 3), ("/d/same", "h", 3)], inv)
    got = {r.operation_id: (r.status, r.final_status, r.success) for r in J.transfer_outcome(ops, src, before, after).collect()}
    assert got == {
        "gone": ("SKIPPED", "completed", False), "same": ("SKIPPED_EXISTING", "completed", True), "same2": ("SKIPPED_EXISTING", "completed", True),
        "wrong": ("FAILED", "failed", False), "new": ("VERIFIED", "completed", True), "bad": ("FAILED", "failed", False), "lost": ("FAILED", "failed", False)}
    todo = {r.operation_id: r.status for r in J.transfer_outcome(ops, src, before).collect()}
    assert todo["new"] == "NEW" and todo["same"] == "SKIPPED_EXISTING"
    tally = A.transfer_tally(J.transfer_outcome(ops, src, before, after)).first()
    assert (tally.total, tally.verified, tally.skipped, tally.failed, tally.total_bytes) == (7, 1, 3, 3, 3)


def test_backup_compare_ignores_unhashed(spark):
    s = "rel_path string, sha256 string, size_bytes long"
    p = spark.createDataFrame([("a", "1", 10), ("b", "2", 10), ("c", None, 10), ("d", "4", 40)], s)
    b = spark.createDataFrame([("a", "1", 10), ("b", "9", 10), ("e", "5", 1)], s)
    r = A.backup_verdict(J.compare_backup(p, b), p).first()
    assert (r.missing, r.extra, r.mismatch, r.verified, r.status) == (1, 1, 1, 1, "FAIL")
    assert (r.primary_files, r.missing_bytes, r.missing_bytes_estimate) == (4, 40, 17.5)


def test_reconciliation_shares(spark):
    rows = [("A", 8234), ("B", 1200), ("C", 1913), ("D", 1500)]
    df = spark.createDataFrame(rows, "category string, n int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert {r.category: r.share_pct for r in A.category_shares(df).collect()} == {"A": 64, "B": 9, "C": 15, "D": 12}


def test_catalog_presence_by_stem(spark):
    files = spark.createDataFrame([("/a/x.jpg",), ("/a/y.png",), ("/a/z.nef",)], "path string")
    cat = spark.createDataFrame([("/a/x.jpg",), ("/a/y.tif",)], "p string")
    assert {r.path: r.in_catalog for r in J.catalog_presence(files, cat).collect()} == {"/a/x.jpg": True, "/a/y.png": True, "/a/z.nef": False}


def test_drive_prefix(spark):
    assets = spark.createDataFrame([(1, "/mnt/a/b/x"), (2, "/mnt/ab/x"), (3, "/other")], "id long, file_path string")
    drives = spark.createDataFrame([("/mnt/a", "A"), ("/mnt/a/b", "B")], "mount_path string, nickname string")
    assert {r.id: r.nickname for r in J.with_drive(assets, drives).collect()} == {1: "B", 2: "A", 3: None}
    assert J.with_drive(assets, drives, longest=False).count() == 4


def test_pair_by_time_is_one_to_one(spark):
    rows = [("/f/a.nef", 100), ("/f/b.jpg", 104), ("/f/c.jpg", 102), ("/f/d.nef", 110), ("/f/e.jpg", 116), ("/f/g.nef", 101)]
    df = spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("t"), F.lit("f").alias("folder"))
    got = {(r.raw_path, r.jpg_path, r.gap_seconds) for r in J.pair_by_time(df, "t").collect()}
    assert got == {("/f/g.nef", "/f/c.jpg", 1)}


def test_rollback_and_checkpoints(spark):
    m = spark.createDataFrame([("o1", "/o1", "/n1", "h", "h", "2024-01-01T00:00:00", "completed"), ("o2", "/o2", "/n2", "h", "x", "2024-01-02T00:00:00", "completed"),
                               ("o3", "/o3", "/n3", "h", "", "2024-01-03T00:00:00", "completed"), ("o4", "/o4", "/n4", "h", "", "2024-01-04T00:00:00", "failed")],
                              "operation_id string, original_path string, new_path string, hash_before string, hash_after string, timestamp string, status string")
    now = spark.createDataFrame([("/n1", "h"), ("/n2", "h")], "path string, sha256 string")
    got = {r.operation_id: r.status for r in X.rollback_plan(m, now).collect()}
    assert got == {"o1": "dry_run", "o2": "failed", "o3": "skipped"}
    assert [r.operation_id for r in X.rollback_plan(m, now, n=1).collect()] == ["o3"]
    assert {r.operation_id for r in X.rollback_candidates(m, "2024-01-03 12:00:00", 24).collect()} == {"o3"}


def test_stale_rules(spark):
    rows = [("a", "RUNNING", "2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("b", "RUNNING", "2024-01-01 00:00:01", "2024-01-01 00:00:00"),
            ("c", "PAUSED", None, "2023-01-01 00:00:00"), ("d", "COMPLETED", "2023-01-01 00:00:00", "2023-01-01 00:00:00")]
    log = spark.createDataFrame(rows, "task_id string, status string, last_heartbeat string, started_at string").select(
        "task_id", "status", F.to_timestamp("last_heartbeat").alias("last_heartbeat"), F.to_timestamp("started_at").alias("started_at"))
    assert {r.task_id for r in T.expire_stale(log, "2024-01-01 00:05:01").filter("status = 'FAILED'").collect()} == {"a"}
    assert {r.task_id for r in T.expire_stale(log, "2024-01-01 00:05:01", null_is_start=True).filter("status = 'FAILED'").collect()} == {"a", "c"}


def test_audit_sample_is_exact(spark):
    df = spark.range(5000).select(F.format_string("/p/%d", "id").alias("path"))
    got = {r.path for r in A.audit_sample(df, 0.05, 100, "s").collect()}
    import hashlib

    ranked = sorted((hashlib.md5(f"s/p/{i}".encode()).hexdigest(), f"/p/{i}") for i in range(5000))
    assert got == {p for _, p in ranked[:250]}
    assert A.audit_sample(df.limit(40), 0.05, 100).count() == 40


def test_deep_pages_without_a_sort_of_the_table(spark):
    import random

    from assetlake.operators import sorting as L

    r = random.Random(4)
    rows = [(f"/p{i:05d}", r.choice([None, 1, 1, 1, 2, 3, 50, 700])) for i in range(5000)]
    df = spark.createDataFrame(rows, "path string, size_bytes int").repartition(6)
    for down in (False, True):
        key = lambda x: ((x[1] is not None, x[1] or 0) if not down else (x[1] is None, -(x[1] or 0)), x[0])
        want = sorted(rows, key=key)
        for number in (1, 3, 100, 167, 168, 400):
            got, total = L.page(df, number, 30, "size_bytes", down, top_rows=90, cuts=7)
            assert [tuple(x) for x in got.collect()] == want[30 * (number - 1):30 * number]
        assert tuple(total.first()) == (5000, 167)
    assert [x.path for x in L.page(df, 50, 30, "path", top_rows=90)[0].collect()] == [x[0] for x in sorted(rows)[1470:1500]]
    plan = L.page(df, 100, 30, "size_bytes", top_rows=90)[0]._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_counter_in_a_document_name_is_no_tax_form(spark):
    from assetlake.plans.rename import document_plan

    names = {"IMG_001099.NEF": "Document", "IMG_109900.NEF": "Document", "scan_1099.pdf": "Tax", "form w2.pdf": "Tax", "raw2024.pdf": "Document", "tax99.pdf": "Tax"}
    df = spark.createDataFrame([(f"/d/{n}", "2023:03:15 14:30:22", None, "b7e2f1a9ff") for n in names], "path string, date_taken string, modified string, sha256 string")
    got = {r.old_path[3:]: r.new_path.split("_")[1] for r in document_plan(df).collect()}
    assert got == names


def test_deep_page_plans_do_not_grow_with_the_cuts(spark):
    from assetlake.operators import sorting as L

    df = spark.range(3000).select(F.concat(F.lit("/p"), F.format_string("%05d", "id")).alias("path"), (F.col("id") % 7).alias("size_bytes"))
    plans = [L.page(df, 50, 30, "size_bytes", top_rows=90, cuts=n)[0]._jdf.queryExecution().optimizedPlan().toString().count("format_string") for n in (3, 60)]
    assert plans[1] <= plans[0]
