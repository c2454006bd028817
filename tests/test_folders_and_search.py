"""Comparison by folder digests and search by trigrams, beside the plain forms."""

import pytest
from pyspark.sql import functions as F

from assetlake.operators import folders as M
from assetlake.operators import joins as J
from assetlake.operators.filters import search_text
from assetlake.sources import search as I


@pytest.fixture
def sides(spark):
    """Forty folders and the top; one folder holds half of all files. Three folders differ."""
    n = F.col("id")
    folder = F.when(n % 2 == 0, "big/deep/").when(n % 41 == 0, "").otherwise(F.concat(F.lit("f"), (n % 40).cast("string"), F.lit("/x/")))
    files = spark.range(4000).select(
        F.concat(folder, n.cast("string"), F.lit(".jpg")).alias("rel_path"), F.sha2(n.cast("string"), 256).alias("sha256"), n.alias("size_bytes"))
    at = F.col("size_bytes")
    backup = files.filter("size_bytes <> 1001").withColumn("sha256", F.when(at == 1003, F.reverse("sha256")).when(at == 1005, "").otherwise(F.col("sha256")))
    more = spark.createDataFrame([("new/a.jpg", "aa", 1), ("f7/x/b.jpg", "bb", 2)], "rel_path string, sha256 string, size_bytes long")
    return files, backup.unionByName(more)


@pytest.mark.parametrize("most", [100_000, 1])
def test_comparison_by_folder_is_the_comparison(spark, sides, most):
    want = J.compare_backup(*sides)
    got = M.compare_backup_by_folder(*sides, most_broadcast=most)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_only_differing_folders_are_joined(spark, sides):
    apart = M.compare_digests(*[M.folder_digests(M._hashed(df)) for df in sides]).filter("not same")
    rows = {r.folder: (r.files_1, r.files_2) for r in apart.collect()}
    assert set(rows) == {"new", "f1/x", "f3/x", "f5/x", "f7/x"} and rows["new"] == (0, 1)
    plan = M.compare_backup_by_folder(*sides)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    joined = sum(df.filter(F.col("rel_path").rlike("^(f[1357]/x|new)/") & (F.col("sha256") != "")).count() for df in sides)
    assert sum(a + b for a, b in rows.values()) == joined < 800  # of 8,000 rows


def test_trees(spark, sides):
    got = {r.folder: (r.files_1, r.files_2, r.same) for r in M.compare_trees(*sides).collect()}
    assert got["big"] == got["big/deep"] == (2000, 2000, True) and got[""] == (4000, 4000, False)
    assert got["f7"][2] is False and got["f9/x"][2] is True and got["new"] == (0, 1, False)


def test_equal_sums_need_equal_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "rel_path string, sha256 string, size_bytes long")
    a = make([("d/a", "1", 2), ("d/b", "3", 4)])
    for other in ([("d/a", "3", 2), ("d/b", "1", 4)], [("d/a", "1", 2)] * 2 + [("d/b", "3", 4)], [("d/a", "1", 4), ("d/b", "3", 2)], [("d/a", "12", 2), ("d/b", "3", 4)]):
        assert [r.same for r in M.compare_digests(M.folder_digests(a), M.folder_digests(make(other))).collect()] == [False]
    assert [r.same for r in M.compare_digests(M.folder_digests(a), M.folder_digests(make([("d/b", "3", 4), ("d/a", "1", 2)]))).collect()] == [True]
    assert M.compare_backup_by_folder(a.filter("false"), a.filter("false")).count() == 0


def test_search_by_trigrams(spark, tmp_path):
    path, names = str(tmp_path / "s"), ["name", "camera"]
    shoot = F.substring(F.sha2(F.floor(F.col("id") / 250).cast("string"), 256), 1, 8)
    rows = spark.range(5000).select(
        "id", F.concat(shoot, F.format_string("/IMG_%05d_Ärger.jpg", F.col("id"))).alias("name"), F.when(F.col("id") % 1000 == 0, "Nikon %D_7").alias("camera"))
    I.write_searchable(rows, path, names, "name", block_rows=500)
    written = spark.read.parquet(f"{path}/rows")
    some = rows.filter("id = 1234").first().name[:8]
    for text in ("_0123", "IKON %d_", "ÄRG", "g", "", "zzzz", "01234_ärger.JPG", "jpgnik", some, some[1:].upper()):
        want = rows.filter(search_text(text, *names))
        assert sorted(r.id for r in I.search(spark, path, text, names).select("id").collect()) == sorted(r.id for r in want.select("id").collect()), text
    few, home = I.blocks_with(spark, path, some), {r[0] for r in written.filter("id between 1000 and 1249").select(I.BLOCK).distinct().collect()}
    assert home <= set(few) and len(few) <= 3 and written.select(I.BLOCK).distinct().count() > 8
    assert I.blocks_with(spark, path, "g") is None and I.blocks_with(spark, path, "zzzz") == []
    found = I.search(spark, path, some, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and I.BLOCK in plan
    opened = found.select(F.input_file_name()).distinct().count()
    assert opened <= len(few) < len(written.inputFiles())
    none = str(tmp_path / "none")
    I.write_searchable(rows.filter("false"), none, names, "name")
    assert I.search(spark, none, some, names).columns == rows.columns and I.search(spark, none, "g", names).count() == 0
