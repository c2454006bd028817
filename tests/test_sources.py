"""Scans, hashing, audit files, checkpoints, keyed writes."""

import hashlib
import json
import os

import pytest

from assetlake.operators import filters as X
from assetlake.operators import sorting as L
from assetlake.sources import readers as S
from assetlake.sources import writers as Z


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "one.JPG").write_bytes(b"111")
    (tmp_path / "a" / "deep" / "two.mp4").write_bytes(b"22222")
    (tmp_path / "b" / "one.txt").write_bytes(b"111")
    return tmp_path


def test_scan_roots(spark, tree):
    files, errors = S.scan_roots(spark, [str(tree / "a"), str(tree / "missing"), str(tree / "b")])
    got = {(r.filename, r.extension, r.size_bytes, r.file_type, r.folder_index) for r in files.collect()}
    assert got == {("one.JPG", ".jpg", 3, "IMAGE", 0), ("two.mp4", ".mp4", 5, "VIDEO", 0), ("one.txt", ".txt", 3, "OTHER", 2)}
    assert [r.path for r in errors.collect()] == [str(tree / "missing")]
    flat = S.scan_files(spark, str(tree / "a"), recursive=False, suffixes=[".JPG"])
    assert [r.filename for r in flat.collect()] == ["one.JPG"]


def test_hashing_in_chunks_and_errors(spark, tree):
    big = b"0123456789abcdef" * (600 << 10)
    (tree / "big.bin").write_bytes(big)
    got = {r.path.rsplit("/", 1)[-1]: r for r in S.hash_files(spark, str(tree)).collect()}
    assert got["one.JPG"].sha256 == hashlib.sha256(b"111").hexdigest() and got["one.JPG"].md5 == hashlib.md5(b"111").hexdigest()
    assert got["big.bin"].sha256 == hashlib.sha256(big).hexdigest() and got["big.bin"].error is None
    gone = spark.createDataFrame([(str(tree / "gone"), 1), (str(tree / "b" / "one.txt"), 3)], "path string, size_bytes long")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in S.add_hashes(gone).collect()}
    assert rows["gone"].sha256 is None and rows["gone"].error and rows["one.txt"].sha256 and not rows["one.txt"].error


def test_any_name_that_cannot_be_read_is_a_row(spark, tree):
    (tree / "a b%20#?.txt").write_bytes(b"odd")
    names = [f"file://{tree}/a b%20#?.txt", "s3://b/a b%.jpg", "nowhere://x/y z", "://", "", "bad\0name", None]
    df = spark.createDataFrame([(n, 1) for n in names], "path string, size_bytes long")
    rows = {r.path: r for r in S.add_hashes(df).collect()}
    assert set(rows) == set(names)
    assert rows[names[0]].sha256 == hashlib.sha256(b"odd").hexdigest() and rows[names[0]].error is None
    assert all(rows[n].error and rows[n].sha256 is None for n in names[1:])


def test_unchanged_files_are_not_opened(spark, tree):
    first = S.hash_files(spark, str(tree))
    known = spark.createDataFrame([(r.path, r.size_bytes, r.modified, "m", "known") for r in first.collect() if r.path.endswith("JPG")],
                                  "path string, size_bytes long, modified timestamp, md5 string, sha256 string")
    opened = spark.sparkContext.accumulator(0)
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in S.hash_files(spark, str(tree), known=known, opened=opened).collect()}
    assert got["one.JPG"] == "known" and got["one.txt"] == hashlib.sha256(b"111").hexdigest() and len(got) == 3
    assert opened.value == 2


def test_two_stage_files_reads_only_candidates(spark, tmp_path):
    from assetlake.operators.duplicates import two_stage_files

    head = b"x" * (1 << 20)
    contents = {"a": b"one", "b": b"one", "c": b"two", "d": b"alone!", "e": head + b"1", "f": head + b"1", "g": head + b"2", "h": b"y" * (1 << 20) + b"1"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    opened = spark.sparkContext.accumulator(0)
    groups = two_stage_files(S.scan_files(spark, str(tmp_path)), opened=opened).collect()
    assert sorted((r.sha256, r.copies) for r in groups) == sorted((hashlib.sha256(d).hexdigest(), 2) for d in (b"one", head + b"1"))
    # Seven share a size and are opened for their first part; three share that too and are read whole.
    assert opened.value == 7 + 3


def test_audit_by_suffix(spark, tmp_path):
    p = tmp_path / "audit.json"
    p.write_text(json.dumps({"file_records": [{"path": "/a", "size_bytes": 5, "duration": "1.5", "sha256": ""}]}))
    r = S.load_audit(spark, str(p)).first()
    assert (r.path, r.size_bytes, r.duration, r.sha256) == ("/a", 5, 1.5, None)
    with pytest.raises(ValueError):
        S.load_audit(spark, str(tmp_path / "audit.xml"))


def test_audit_csv_header_is_sorted_union(spark, tmp_path):
    a = spark.createDataFrame([("/a,\"x\"", 1)], "path string, iso int")
    b = spark.createDataFrame([("/b", "h264")], "path string, codec string")
    out = str(tmp_path / "out.csv")
    Z.write_audit_csv([a, b], out)
    part = next(f for f in os.listdir(out) if f.startswith("part") and f.endswith(".csv"))
    assert open(f"{out}/{part}").readline().strip() == "codec,iso,path"
    assert {(r.path, r.iso, r.codec) for r in S.load_audit(spark, out).collect()} == {("/a,\"x\"", 1, None), ("/b", None, "h264")}


def test_newest_checkpoint(spark, tmp_path):
    for i, name in enumerate(["c1.json", "c2.json", "c3.json"]):
        p = tmp_path / name
        p.write_text(json.dumps({"last_completed_op_id": name, "last_completed_index": i}, indent=2))
        os.utime(p, (1000 + [5, 9, 7][i], 1000 + [5, 9, 7][i]))
    assert S.newest_checkpoint(spark, str(tmp_path)).first().last_completed_op_id == "c2.json"


def test_manifest_parts(spark):
    from assetlake.plans.transfer import operation_manifest

    plan = spark.range(25).selectExpr("concat('/a/', id) as old_path", "concat('/b/', id) as new_path")
    m = operation_manifest(plan, "s", "2024-01-01T00:00:00", None)
    docs = Z.manifest_documents(m, "t", "2024-01-01T00:00:00", per_document=10).collect()
    sizes = sorted(len(json.loads(d.document)["operations"]) for d in docs)
    assert sizes == [5, 10, 10]


def test_upsert_and_defaults(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "9"), ("c", "3")], "key string, value string")
    assert {tuple(r) for r in Z.upsert(base, new, ["key"]).collect()} == {("a", "1"), ("b", "9"), ("c", "3")}
    assert {tuple(r) for r in Z.insert_missing(base, new, ["key"]).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert Z.default_settings(spark).count() == 5


def test_json_validity(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("{broken",), ("",)], "value string")
    r = Z.line_validity(lines).first()
    assert (r.documents, r.invalid) == (3, 2)


def test_filters(spark):
    df = spark.createDataFrame([("50%_off.jpg", "/x", None, 5), ("5000off.jpg", "/x", "D850", 7)], "filename string, path string, camera_model string, size_bytes long")
    assert [r.filename for r in X.filter_assets(df, X.AssetFilter(name_contains="50%_")).collect()] == ["50%_off.jpg"]
    assert X.filter_assets(df, X.AssetFilter(text="d85")).count() == 1
    assert X.filter_assets(df, X.AssetFilter()).count() == 2
    with pytest.raises(ValueError):
        L.sort_by(df, "size; drop")


def test_months_and_buckets_that_are_not_asked_for_stay_closed(spark, tmp_path):
    from pyspark.sql import functions as F

    from assetlake.sources import tables as K

    path = str(tmp_path / "months")
    df = spark.range(3000).select(
        "id", F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("file_path"), F.when(F.col("id") % 50 > 0, F.timestamp_seconds(1_672_531_200 + F.col("id") * 10_000)).alias("ingested_date"))
    K.write_by_month(df, path)
    got = K.read_by_month(spark, path, "2023-03-05 10:00:00", "2023-04-02")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "202303" in plan
    want = df.filter("ingested_date between timestamp'2023-03-05 10:00:00' and timestamp'2023-04-02'")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) and 0 < want.count() < 400
    assert K.read_by_month(spark, path).count() == 3000 and len(got.inputFiles()) > 2

    path = tmp_path / "keyed"
    K.write_keyed(spark.range(1000).withColumn("v", F.lit(0)), str(path), ["id"], 16)
    names = lambda: {str(f.relative_to(path)) for f in path.rglob("*.parquet")}
    before = names()
    new = spark.createDataFrame([(5, 7), (2000, 8)], "id long, v int")
    K.upsert_keyed(spark, str(path), new, ["id"], 16)
    K.upsert_keyed(spark, str(path), new.filter("false"), ["id"], 16)
    touched = {r[0] for r in new.select(K.bucket_of(["id"], 16)).collect()}
    assert before - names() == {f for f in before if int(f.split("=")[1].split("/")[0]) in touched}
    rows = {r.id: r.v for r in K.read_keyed(spark, str(path)).collect()}
    assert rows == {**dict.fromkeys(range(1000), 0), 5: 7, 2000: 8}
    K.upsert_keyed(spark, str(path), spark.createDataFrame([(5, 1), (3000, 9)], "id long, v int"), ["id"], 16, replace=False)
    rows = {r.id: r.v for r in K.read_keyed(spark, str(path)).collect()}
    assert rows == {**dict.fromkeys(range(1000), 0), 5: 7, 2000: 8, 3000: 9}


def test_databases_are_read_in_parts(spark, tmp_path):
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:assets;create=true"
    rows = [(i, f"n{i}") for i in range(1000)] + [(None, "none")]
    spark.createDataFrame(rows, "id long, name string").write.format("jdbc").options(url=url, dbtable="images").save()
    df = S.read_database(spark, url, "images", "id", 5)
    assert df.rdd.getNumPartitions() == 5
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert sum(sizes) == 1001 and max(sizes) < 300
    some = df.filter("id between 10 and 19").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString().lower()
    assert "*greaterthanorequal(id,10)" in plan and "*lessthanorequal(id,19)" in plan and "name" not in plan
    assert sorted(r[0] for r in some.collect()) == list(range(10, 20))
    both = S.read_catalogs(spark, {"one": url, "two": url}, "images", "id", 3)
    assert both.rdd.getNumPartitions() == 6 and both.groupBy("catalog_path").count().count() == 2
    assert S.read_database(spark, url, '(select * from images where "id" = 7) x', "id").rdd.getNumPartitions() == 1
    assert S.read_database(spark, url, "images").rdd.getNumPartitions() == 1


def test_texts_in_files_of_their_own_need_few_folders(spark, tmp_path):
    from pathlib import Path

    from assetlake.sources.writers import write_text_files

    rows = [(i, f"text {i} \u00e9") for i in range(300)] + [(7, "again"), (8, None), (8, "")]
    out = f"{tmp_path}/a b%20c"
    assert write_text_files(spark.createDataFrame(rows, "k long, t string"), out, "k", "t") == 303
    files = [p for p in Path(out).rglob("*") if p.is_file()]
    assert sorted(p.read_text() for p in files) == sorted((t or "") + "\n" for _, t in rows)
    assert len({p.parent for p in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_audit_documents_are_read_once(spark, tmp_path):
    import json

    from assetlake.sources.readers import load_audit

    doc = lambda n: {"file_records": [{"path": f"/{n}/{i}", "size_bytes": i} for i in range(200)]}
    (tmp_path / "a.json").write_text(json.dumps(doc("a"), indent=2))
    (tmp_path / "b.json").write_text(json.dumps([doc("b"), doc("c")]))
    for name, n in (("a", 200), ("b", 400)):
        got = load_audit(spark, f"{tmp_path}/{name}.json")
        assert got.select("path", "size_bytes").distinct().count() == n
    assert "Scan json" not in got._jdf.queryExecution().executedPlan().toString()
